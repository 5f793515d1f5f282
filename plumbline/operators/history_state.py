"""Histories that are kept: new runs are added to a mergeable state, old runs are not read again.

Per series the state holds moments about the mean, the co-moment with the
index, range, ends and first values; two parts merge by their counts and means.
Mann-Kendall needs how many old values lie below each new one. Values are
64-bit keys in order of size, cut into 16 digits; a node (level, digits above)
counts the values per digit. Two values differ first at one node, so the pairs
of old and new points are products of two count arrays, node by node, and a
series of any length is met by as many rows as the new points touch. Level 0
counts every value, which gives ties and the median. Change points compare all
splits with the present totals: the prefix sums of the points are appended and
never changed. Targets keep streak ends and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cumulative import cumulative_counts, exact_quantiles
from ..session import cut_lineage
from . import temporal as T
from .temporal import SERIES, SLICES, TARGET

FIRST = 5  # the baseline window has at most five points
DIGITS = 16  # digits of four bits in a key
_KEYS = ", ".join(f"{c} string" for c in SERIES)
_MOMENTS = {
    "n": "long", "mean": "double", "m2": "double", "cxy": "double", "t1": "double", "t2": "double", "lo": "double", "hi": "double",
    "latest": "double", "previous": "double", "first": "array<double>", "last_index": "int", "higher": "boolean", "s": "long", "ties": "double",
}
_STREAKS = ["n", "cur", "prev", "peak", *[f"r{i}" for i in range(4)], *[f"not{i}" for i in range(4)], "not_up", "elevated", "first_up", "last_up", "last_index"]
_SCHEMAS = {
    "series": _KEYS + ", " + ", ".join(f"{k} {t}" for k, t in _MOMENTS.items()),
    "targets": ", ".join(f"{c} string" for c in TARGET) + ", " + ", ".join(f"{c} long" for c in _STREAKS),
    "nodes": f"{_KEYS}, level int, prefix long, counts array<long>, batch long",
    "splits": f"{_KEYS}, pos long, run_id string, run_index int, s1 double, s2 double, batch long",
}
_GROWING = ("nodes", "splits")


def ordered_key(value: Column) -> Column:
    """A long in the order of the doubles (sign, exponent, fraction); values are taken at nine digits, as ties are."""
    v = F.round(value, 9)
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    part = size * F.pow(F.lit(2.0), -guess)
    # The logarithm may round to the neighbouring power.
    power = guess + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
    part = F.when(part >= 2, part / 2).when(part < 1, part * 2).otherwise(part)
    bits = (power + 1023).cast("long") * F.lit(2**52) + ((part - 1) * F.lit(2.0**52)).cast("long")
    return F.when(size == 0, F.lit(0).cast("long")).when(v < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The value of a key."""
    size = F.abs(key)
    part = F.lit(1.0) + size.bitwiseAND(F.lit(2**52 - 1)) / F.lit(2.0**52)
    value = part * F.pow(F.lit(2.0), (F.shiftright(size, 52) - 1023).cast("double"))
    return F.when(key == 0, F.lit(0.0)).when(key < 0, -value).otherwise(value)


def value_nodes(obs: DataFrame) -> DataFrame:
    """Counts per digit of every node that the values touch: SERIES, level, prefix, counts."""
    values = obs.groupBy(*SERIES, ordered_key(F.col("metric_value")).alias("key")).agg(F.count(F.lit(1)).alias("k"))
    top = DIGITS - 1
    # Shifting by 64 bits would shift by none. The sign bit of the top digit is turned, so that negative keys come first.
    levels = F.array(*[
        F.struct(
            F.lit(i).alias("level"),
            (F.lit(0).cast("long") if i == top else F.shiftright("key", 4 * i + 4)).alias("prefix"),
            F.shiftright("key", 4 * i).bitwiseAND(F.lit(15)).bitwiseXOR(F.lit(8 if i == top else 0)).cast("int").alias("digit"),
        ) for i in range(DIGITS)
    ])
    spread = values.select(*SERIES, "k", F.inline(levels))
    counts = F.array(*[F.sum(F.when(F.col("digit") == d, F.col("k")).otherwise(0)) for d in range(16)])
    return spread.groupBy(*SERIES, "level", "prefix").agg(counts.alias("counts"))


def _sums() -> Column:
    return F.array(*[F.sum(F.get("counts", F.lit(d))) for d in range(16)])


def _later_pairs(old: Column, new: Column) -> Column:
    """Pairs of an old and a new value that part at this node: ascending ones less descending ones."""
    total = F.aggregate(old, F.lit(0).cast("long"), lambda t, k: t + k)
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("s"))
    step = lambda acc, i: F.struct(
        (acc["below"] + F.get(old, i)).alias("below"), (acc["s"] + F.get(new, i) * (acc["below"] * 2 + F.get(old, i) - total)).alias("s"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), start, step, lambda acc: acc["s"])


def _more_ties(old: Column, new: Column) -> Column:
    term = lambda k: k * (k - 1) * (k * 2 + 5)
    grown = F.zip_with(old, new, lambda a, b: term((a + b).cast("double")) - term(a.cast("double")))
    return F.aggregate(grown, F.lit(0.0), lambda t, x: t + x)


@dataclass
class HistoryState:
    """Tables of the histories so far; the results are those of the operators of the same names over all runs."""

    series: DataFrame
    targets: DataFrame
    nodes: DataFrame
    splits: DataFrame
    batch: int = 0

    def save(self, folder: str) -> None:
        """Write the state of this batch: what a batch adds in a part of its own, tables with a row per series or target as a whole."""
        for name in _SCHEMAS:
            rows = getattr(self, name)
            rows = rows.filter(F.col("batch") == self.batch) if name in _GROWING else rows
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/{self.batch}")

    def trend(self) -> DataFrame:
        n = F.col("n").cast("double")
        sxx = n * (n * n - 1) / 12
        short = F.col("n") < 3
        slope = F.when(short, F.lit(0.0)).otherwise(F.try_divide("cxy", sxx))
        r2 = F.when(short | (F.col("hi") <= F.col("lo")), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("cxy") * F.col("cxy"), sxx * F.col("m2")), F.lit(0.0)))
        std = F.sqrt(F.col("m2") / n)
        cv = F.when(F.abs("mean") > 1e-6, std / F.abs("mean")).otherwise(F.lit(0.0))
        placed = self.series.select(*SERIES, "n", slope.alias("slope"), r2.alias("r2"), cv.alias("cv"), (F.col("hi") - F.col("lo")).alias("spread"), "higher")
        named = T.direction(F.col("n"), F.col("slope"), F.col("r2"), F.col("cv"), F.col("spread"), F.col("higher"))
        return placed.select(*SERIES, "n", "slope", "r2", named.alias("direction"))

    def mann_kendall(self) -> DataFrame:
        return T.kendall_test(self.series.select(*SERIES, "n", F.col("ties").alias("_ties"), "s"))

    def medians(self) -> DataFrame:
        """Median per series at nine digits, from the counts of values."""
        leaves = self.nodes.filter("level = 0").groupBy(*SERIES, "prefix").agg(_sums().alias("counts"))
        values = leaves.select(*SERIES, "prefix", F.posexplode("counts").alias("digit", "k")).filter("k > 0")
        key = F.shiftleft("prefix", 4).bitwiseOR(F.col("digit").cast("long"))
        values = values.select(*SERIES, key_value(key).alias("v"), "k")
        return exact_quantiles(cumulative_counts(values, SERIES, "v", {"w": F.col("k")}, SLICES, bounded_keys=False), SERIES, "v", "w", {"median": 0.5}).drop("n")

    def metric_history(self) -> DataFrame:
        n = F.col("n")
        window = F.greatest(F.lit(1), F.least(F.lit(FIRST), F.floor(n / 2))).cast("int")
        head = F.slice("first", F.lit(1), window)
        mean = F.aggregate(head, F.lit(0.0), lambda t, x: t + x) / window
        rows = self.series.withColumn("_bm", mean)
        spread = F.aggregate(head, F.lit(0.0), lambda t, x: t + (x - F.col("_bm")) * (x - F.col("_bm")))
        rows = rows.withColumns({"std": F.sqrt(F.col("m2") / n), "_bs": F.sqrt(spread / window), "_prev": F.coalesce("previous", "latest")})
        delta = F.col("latest") - F.col("_prev")
        return rows.join(self.medians(), SERIES).select(
            *SERIES, "n", "mean", "median", "std",
            F.when(F.abs("mean") > 1e-6, F.col("std") / F.abs("mean")).otherwise(F.lit(0.0)).alias("cv"),
            F.col("lo").alias("min"), F.col("hi").alias("max"), "latest", F.col("_prev").alias("previous"), delta.alias("delta"),
            (delta / F.greatest(F.abs("_prev"), F.lit(1e-6))).alias("relative_delta"),
            F.col("_bm").alias("baseline_mean"), F.col("_bs").alias("baseline_std"),
            F.when(F.col("_bs") > 1e-6, (F.col("latest") - F.col("_bm")) / F.col("_bs")).otherwise(F.lit(0.0)).alias("standardized_latest"),
        )

    def change_point(self, min_split: int = 2, min_shift: float = 0.05) -> DataFrame:
        totals = self.series.select(*SERIES, "n", "t1", "t2")
        return T.best_split(self.splits.join(totals, SERIES), min_split, min_shift)

    def persistence(self) -> DataFrame:
        return T.classify_streaks(self.targets.drop("last_index"), TARGET)


def empty_history(spark: SparkSession) -> HistoryState:
    return HistoryState(**{name: spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()})


def load_history(spark: SparkSession, folder: str, batch: int) -> HistoryState:
    """The state as saved after ``batch``; a batch that failed half-way is run again from the one before."""
    def read(name: str, schema: str) -> DataFrame:
        first = 1 if name in _GROWING else batch
        return spark.read.schema(schema).parquet(*[f"{folder}/{name}/{b}" for b in range(first, batch + 1)])

    return HistoryState(**{name: read(name, schema) for name, schema in _SCHEMAS.items()}, batch=batch)


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return both(old, "a").join(both(new, "b"), keys, "full")


def _merged(joined: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Fields of both parts where a key has two, else those of the only one."""
    a, b = F.col("a"), F.col("b")
    return joined.select(*keys, *[F.when(a.isNull(), b[k]).when(b.isNull(), a[k]).otherwise(c).alias(k) for k, c in fields.items()])


def _add_series(state: HistoryState, p: DataFrame, obs: DataFrame, nodes: DataFrame) -> DataFrame:
    v, pos, n = F.col("metric_value"), F.col("pos"), F.col("n")
    part = p.groupBy(*SERIES).agg(
        F.max("n").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), (F.covar_pop(pos.cast("double"), v) * F.count(v)).alias("cxy"),
        F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.max(F.when(pos == n - 1, v)).alias("latest"), F.max(F.when(pos == n - 2, v)).alias("previous"),
        # At most FIRST values.
        F.transform(F.array_sort(F.collect_list(F.when(pos < FIRST, F.struct(pos.alias("pos"), v.alias("v"))))), lambda x: x["v"]).alias("first"),
        F.max("run_index").cast("int").alias("last_index"), F.max("higher_is_better").alias("higher"),
    )
    before = state.nodes.join(nodes.select(*SERIES, "level", "prefix"), [*SERIES, "level", "prefix"], "left_semi")
    before = before.groupBy(*SERIES, "level", "prefix").agg(_sums().alias("old"))
    none = F.array_repeat(F.lit(0).cast("long"), 16)
    met = nodes.join(before, [*SERIES, "level", "prefix"], "left").withColumn("old", F.coalesce("old", none))
    across = met.groupBy(*SERIES).agg(
        F.sum(_later_pairs(F.col("old"), F.col("counts"))).alias("across"),
        F.sum(F.when(F.col("level") == 0, _more_ties(F.col("old"), F.col("counts"))).otherwise(F.lit(0.0))).alias("ties"),
    )
    inside = T.ascents(obs.select(*SERIES, "run_index", F.round("metric_value", 9).alias("v")), 1)
    part = part.join(across, SERIES).join(inside.withColumnRenamed("s", "inside"), SERIES, "left")
    part = part.withColumn("s", (F.coalesce("inside", F.lit(0)) + F.col("across")).cast("long")).select(*SERIES, *_MOMENTS)

    a, b = F.col("a"), F.col("b")
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    d = b["mean"] - a["mean"]
    return _merged(_paired(state.series, part, SERIES), SERIES, {
        "n": a["n"] + b["n"],
        "mean": a["mean"] + d * nb / (na + nb),
        "m2": a["m2"] + b["m2"] + d * d * na * nb / (na + nb),
        # The mean indices of the two parts lie half of all points apart.
        "cxy": a["cxy"] + b["cxy"] + d * na * nb / 2,
        "t1": a["t1"] + b["t1"], "t2": a["t2"] + b["t2"],
        "lo": F.least(a["lo"], b["lo"]), "hi": F.greatest(a["hi"], b["hi"]),
        "latest": b["latest"], "previous": F.coalesce(b["previous"], a["latest"]),
        "first": F.slice(F.concat(a["first"], b["first"]), 1, FIRST),
        "last_index": b["last_index"], "higher": a["higher"] | b["higher"], "s": a["s"] + b["s"], "ties": a["ties"] + b["ties"],
    })


def _add_targets(state: HistoryState, obs: DataFrame) -> DataFrame:
    seq = T.target_runs(obs).join(state.targets.select(*TARGET, "last_index"), TARGET, "left").filter("last_index IS NULL OR run_index > last_index").drop("last_index")
    seq = cut_lineage(seq)
    last = seq.groupBy(*TARGET).agg(F.max("run_index").alias("last_index"))
    part = T.streaks(seq, TARGET).join(last, TARGET).select(*TARGET, *[F.col(c).cast("long").alias(c) for c in _STREAKS])
    a, b = F.col("a"), F.col("b")
    n = a["n"]
    # The first ranks of the new part stand behind the old points.
    rank = lambda i: F.coalesce(a[f"r{i}"], F.get(F.array(*[b[f"r{j}"] for j in range(4)]), F.greatest(F.lit(i) - n, F.lit(0)).cast("int")))
    later = lambda c: F.when(b[c] >= 0, b[c] + n).otherwise(a[c])
    return _merged(_paired(state.targets, part, TARGET), TARGET, {
        "n": n + b["n"], "cur": b["cur"], "prev": F.when(b["n"] == 1, a["cur"]).otherwise(b["prev"]), "peak": F.greatest(a["peak"], b["peak"]),
        **{f"r{i}": rank(i) for i in range(4)}, **{c: later(c) for c in ("not0", "not1", "not2", "not3", "not_up")},
        "elevated": a["elevated"] + b["elevated"], "first_up": F.coalesce(a["first_up"], b["first_up"] + n),
        "last_up": F.coalesce(b["last_up"] + n, a["last_up"]), "last_index": b["last_index"],
    })


def add_runs(state: HistoryState, obs: DataFrame) -> HistoryState:
    """The state after further runs; save and load it between batches.

    ``obs`` are graded observations (SERIES, run_id, run_index, metric_value,
    severity, higher_is_better). Runs come in the order of their index: a point
    at or before the last one of its series is known already and passed over,
    so a batch may be sent again. A run that is put in between needs a new state.
    Empty batches and series that begin or pause in any batch are fine.
    """
    batch = F.lit(state.batch + 1).cast("long").alias("batch")
    known = state.series.select(*SERIES, "last_index", F.col("n").alias("_n"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    fresh = obs.join(known.select(*SERIES, "last_index"), SERIES, "left").filter("last_index IS NULL OR run_index > last_index").drop("last_index")
    fresh = cut_lineage(fresh.select(*SERIES, "run_id", "run_index", "metric_value", "higher_is_better"))
    p = cut_lineage(T.positions(fresh))
    nodes = cut_lineage(value_nodes(fresh))
    zero = F.lit(0.0)
    splits = p.join(known, SERIES, "left").select(
        *SERIES, (F.col("pos") + F.coalesce("_n", F.lit(0))).cast("long").alias("pos"), "run_id", F.col("run_index").cast("int").alias("run_index"),
        (F.col("s1") + F.coalesce("_t1", zero)).alias("s1"), (F.col("s2") + F.coalesce("_t2", zero)).alias("s2"), batch)
    return HistoryState(
        series=cut_lineage(_add_series(state, p, fresh, nodes)),
        targets=cut_lineage(_add_targets(state, obs)),
        nodes=state.nodes.unionByName(nodes.select(*SERIES, "level", "prefix", "counts", batch)),
        splits=state.splits.unionByName(cut_lineage(splits)),
        batch=state.batch + 1,
    )
