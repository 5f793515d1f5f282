"""Ordered state changes per key, checked against a transition table.

A change maps every state to a state, and such maps compose, so a key's actions
are cut into chunks of bounded size: chunk maps give each chunk its starting
state, then every chunk is replayed on its own. No task sees a whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import running_totals

# Allowed transitions of alerts and incidents.
ALERT_TRANSITIONS = {
    "OPEN": ["ACKNOWLEDGED", "INVESTIGATING", "SUPPRESSED", "RESOLVED"],
    "ACKNOWLEDGED": ["INVESTIGATING", "SUPPRESSED", "RESOLVED"],
    "INVESTIGATING": ["ACKNOWLEDGED", "SUPPRESSED", "RESOLVED"],
    "SUPPRESSED": ["OPEN", "REOPENED", "INVESTIGATING", "RESOLVED"],
    "RESOLVED": ["REOPENED"],
    "REOPENED": ["ACKNOWLEDGED", "INVESTIGATING", "SUPPRESSED", "RESOLVED"],
}
INCIDENT_TRANSITIONS = {
    "OPEN": ["ACKNOWLEDGED", "INVESTIGATING", "MITIGATION_PLANNED", "SUPPRESSED", "RESOLVED"],
    "ACKNOWLEDGED": ["INVESTIGATING", "MITIGATION_PLANNED", "SUPPRESSED", "RESOLVED"],
    "INVESTIGATING": ["MITIGATION_PLANNED", "VALIDATING", "MONITORING", "SUPPRESSED", "RESOLVED"],
    "MITIGATION_PLANNED": ["VALIDATING", "INVESTIGATING", "SUPPRESSED", "RESOLVED"],
    "VALIDATING": ["MONITORING", "INVESTIGATING", "MITIGATION_PLANNED", "SUPPRESSED", "RESOLVED"],
    "MONITORING": ["RESOLVED", "INVESTIGATING", "REOPENED", "SUPPRESSED"],
    "SUPPRESSED": ["OPEN", "REOPENED", "INVESTIGATING", "RESOLVED", "MONITORING"],
    "RESOLVED": ["REOPENED"],
    "REOPENED": ["ACKNOWLEDGED", "INVESTIGATING", "MITIGATION_PLANNED", "SUPPRESSED", "RESOLVED"],
}
CHUNK = 500


def apply_actions(
    state: DataFrame, actions: DataFrame, key: str, transitions: dict[str, Sequence[str]], chunk: int = CHUNK
) -> DataFrame:
    """Verdict per action: key, action_id, acted_at, from_state, to_state, accepted.

    ``state``: key, lifecycle_state. ``actions``: key, action_id, acted_at, target_state.
    A move that the table does not allow leaves the state as it is; repeating the
    current state is accepted.
    """
    names = list(transitions)
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    listed = F.array(*[F.lit(n) for n in names])
    allowed = F.array(*[F.array(*[F.lit(b == a or b in transitions[a]) for b in names]) for a in names])
    step = lambda s, t: F.when((t >= 0) & F.get(F.get(allowed, s), F.greatest(t, F.lit(0))), t).otherwise(s)

    known = actions.join(state.select(key), key, "left_semi")
    keyed = known.select(
        key, F.struct("acted_at", "action_id").alias("_at"), F.coalesce(F.try_element_at(number, F.col("target_state")), F.lit(-1)).alias("_to"), F.lit(1).alias("_one"))
    placed = running_totals(keyed, [key], "_at", ["_one"], bounded_keys=False)
    chunks = placed.withColumn("_chunk", F.floor(F.col("lt__one") / chunk)).groupBy(key, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_to"))).alias("_acts"))
    identity = F.array(*[F.lit(i) for i in range(len(names))])
    maps = chunks.withColumn("_map", F.aggregate("_acts", identity, lambda m, a: F.transform(m, lambda s: step(s, a["_to"]))))
    # One map per chunk of a key: the list is chunk times shorter than the history.
    start = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_map"))).alias("_maps")).join(
        state.select(key, F.try_element_at(number, F.col("lifecycle_state")).alias("_s0")), key)
    walked = F.aggregate("_maps", F.array(F.col("_s0")), lambda acc, m: F.concat(acc, F.array(F.get(m["_map"], F.element_at(acc, -1)))))
    begins = start.select(key, F.posexplode(F.slice(walked, 1, F.size("_maps"))).alias("_chunk", "_begin"))
    opening = F.array(F.struct(F.col("_begin").alias("s"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("id"),
                               F.lit(-1).alias("f"), F.lit(-1).alias("t")))
    replay = F.aggregate(
        "_acts", opening,
        lambda acc, a: F.concat(acc, F.array(F.struct(
            step(F.element_at(acc, -1)["s"], a["_to"]).alias("s"), a["_at"]["acted_at"].cast("timestamp").alias("at"),
            a["_at"]["action_id"].cast("string").alias("id"), F.element_at(acc, -1)["s"].alias("f"), a["_to"].alias("t")))))
    rows = chunks.join(begins, [key, "_chunk"]).select(key, F.explode(F.slice(replay, 2, F.size("_acts"))).alias("r"))
    return rows.select(
        key, F.col("r.id").alias("action_id"), F.col("r.at").alias("acted_at"), F.get(listed, F.col("r.f")).alias("from_state"),
        F.get(listed, F.col("r.s")).alias("to_state"), ((F.col("r.t") >= 0) & (F.col("r.s") == F.col("r.t"))).alias("accepted"))


def final_states(state: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """State table after all accepted actions."""
    last = verdicts.groupBy(key).agg(
        F.max_by("to_state", F.struct("acted_at", "action_id")).alias("_new"), F.count_if("accepted").alias("accepted_actions"),
        F.count_if(~F.col("accepted")).alias("rejected_actions"))
    out = state.join(last, key, "left").withColumn("lifecycle_state", F.coalesce("_new", "lifecycle_state"))
    return out.drop("_new").fillna(0, ["accepted_actions", "rejected_actions"])


