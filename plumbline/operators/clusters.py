"""Incident clusters that are kept: a batch of alerts is contracted into the components found before.

The state knows which hub lies in which component, so a new alert needs its own
hubs only. Links are formed among new alerts and the components that their hubs
name; components are found on those links, and old components that meet become
one, which is recorded as a merge. Alerts keep the component they entered;
``components`` leads from there to the present one. A context hub ties alerts
only once a GLOBAL alert takes part; until then its members wait in ``waiting``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.components import components
from ..session import cut_lineage
from .incidents import hub_cells

_SCHEMAS = {
    "alerts": "alert_id string, entered long, batch long",
    "components": "entered long, root long",
    "keys": "root long, incident_key string, alerts long",
    "hubs": "hub string, entered long, batch long",
    "waiting": "hub string, entered long",
    "merges": "batch long, from_key string, into_key string",
}


@dataclass
class ClusterState:
    """Tables of the clusters so far; ``entered`` is the component in which an alert or a hub was first put."""

    alerts: DataFrame
    components: DataFrame
    keys: DataFrame
    hubs: DataFrame
    waiting: DataFrame
    merges: DataFrame
    batch: int = 0

    def clusters(self) -> DataFrame:
        """``alert_id``, ``incident_key`` of every alert so far; the key is the least alert id of the component."""
        return self.alerts.join(self.components, "entered").join(self.keys, "root").select("alert_id", "incident_key")

    def save(self, folder: str) -> None:
        """Write the state of this batch: what a batch adds in a part of its own, tables that it changes as a whole."""
        for name in _SCHEMAS:
            rows = getattr(self, name)
            rows = rows.filter(F.col("batch") == self.batch) if name in _GROWING else rows
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/{self.batch}")


_GROWING = ("alerts", "hubs", "merges")


def empty_clusters(spark: SparkSession) -> ClusterState:
    return ClusterState(**{name: spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()})


def load_clusters(spark: SparkSession, folder: str, batch: int) -> ClusterState:
    """The state as saved after ``batch``; a batch that failed half-way is run again from the one before."""
    def read(name: str, schema: str) -> DataFrame:
        first = 1 if name in _GROWING else batch
        return spark.read.schema(schema).parquet(*[f"{folder}/{name}/{b}" for b in range(first, batch + 1)])

    return ClusterState(**{name: read(name, schema) for name, schema in _SCHEMAS.items()}, batch=batch)


def add_alerts(state: ClusterState, alerts: DataFrame) -> ClusterState:
    """The state after a further batch of alerts; alerts that it knows already are passed over.

    Save and load the state between batches: plans over tables that were only
    checkpointed carry the conditions of all batches before, and grow with them.

    Any split of alerts into batches ends in the clusters of one whole run. Old
    alerts and hubs are read by semi-joins against the new ones and never
    rewritten; the search for components covers new alerts and the components
    they touch. ``components`` and ``keys``, a row a component, are written anew.
    """
    batch = state.batch + 1
    number = F.lit(batch).cast("long").alias("batch")
    first = state.components.agg(F.coalesce(F.max("entered") + 1, F.lit(0)).alias("n")).first()["n"]
    named = alerts.select("alert_id").distinct()
    repeated = state.alerts.join(named, "alert_id", "left_semi").select("alert_id")
    fresh = cut_lineage(named.join(repeated, "alert_id", "left_anti").withColumn("id", F.monotonically_increasing_id() + F.lit(first)))
    cells = alerts.select("alert_id", F.explode(hub_cells()).alias("c")).join(fresh, "alert_id").select("id", "alert_id", "c.hub", "c.context", "c.anchor")
    cells = cut_lineage(cells.distinct())

    asked = cells.groupBy("hub").agg(F.bool_or("context").alias("context"), F.bool_or("anchor").alias("anchor"))
    known = state.hubs.join(asked.select("hub"), "hub", "left_semi").select("hub", "entered")
    ties = cut_lineage(asked.join(known, "hub", "left").filter(~F.col("context") | F.col("anchor") | F.col("entered").isNotNull()).select("hub", "entered"))
    present = state.components.withColumnRenamed("root", "node")
    old = ties.filter("entered IS NOT NULL").join(present, "entered").select("hub", "node")
    woken = state.waiting.join(ties.select("hub"), "hub", "left_semi")
    members = cells.join(ties, "hub", "left_semi").select("hub", F.col("id").alias("node")).unionByName(old).unionByName(woken.join(present, "entered").select("hub", "node"))
    members = cut_lineage(members.distinct())
    heads = cut_lineage(members.groupBy("hub").agg(F.min("node").alias("head")))
    found = cut_lineage(components(members.join(heads, "hub").select(F.col("node").alias("a"), F.col("head").alias("b"))))

    entered = cut_lineage(fresh.select("alert_id", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("alert_id", "id", F.coalesce("root", "id").alias("entered")))
    moved = cut_lineage(found.filter((F.col("node") < first) & (F.col("node") != F.col("root"))).select("node", F.col("root").alias("to")))
    step = lambda df, c: df.join(moved.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    now = step(state.components, "root").unionByName(entered.filter("id = entered").select("entered", F.col("entered").alias("root")))
    own = entered.groupBy(F.col("entered").alias("root")).agg(F.min("alert_id").alias("incident_key"), F.count(F.lit(1)).alias("alerts"))
    keys = step(state.keys, "root").unionByName(own).groupBy("root").agg(F.min("incident_key").alias("incident_key"), F.sum("alerts").alias("alerts"))
    keys = cut_lineage(keys)
    into = keys.select(F.col("root").alias("to"), F.col("incident_key").alias("into_key"))
    merged = state.keys.withColumnRenamed("root", "node").join(moved, "node").join(into, "to")
    merges = merged.select(number, F.col("incident_key").alias("from_key"), "into_key")

    placed = entered.select("id", "entered")
    new_hubs = heads.join(ties.filter("entered IS NULL").select("hub"), "hub", "left_semi").withColumnRenamed("head", "node")
    homes = new_hubs.join(found, "node", "left").select("hub", F.coalesce("root", "node").alias("entered"))
    asleep = cells.filter("context").join(ties.select("hub"), "hub", "left_anti").join(placed, "id").select("hub", "entered")
    return ClusterState(
        alerts=state.alerts.unionByName(entered.select("alert_id", "entered", number)),
        components=cut_lineage(now),
        keys=keys,
        hubs=state.hubs.unionByName(cut_lineage(homes.withColumn("batch", number))),
        waiting=cut_lineage(state.waiting.join(ties.select("hub"), "hub", "left_anti").unionByName(asleep).distinct()),
        merges=state.merges.unionByName(cut_lineage(merges)),
        batch=batch,
    )
