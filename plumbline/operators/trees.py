"""Scores and Shapley attributions of tree ensembles from a table of paths.

A tree model is a table of nodes. Its root-to-leaf paths become one row a leaf:
the value and, for each feature on the path, the interval that leads along it and
the share of the training rows that does. With ``o`` 1 where a row's value lies
in the interval and 0 elsewhere, and ``z`` that share, a leaf adds

    value * (o_f - z_f) * integral over t in 0..1 of product over g <> f of (z_g + t (o_g - z_g))

to the attribution of feature f: the path-dependent Shapley value. The integrand
is a polynomial, so Gauss-Legendre nodes, half as many as the longest path has
features, give the integral exactly. Paths are folded by array expressions inside
the row; nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage

#: Splits of the paths that are broadcast at once; a larger ensemble is folded part after part.
PART = 100_000
_SPLIT = "struct<feature:string,lo:double,hi:double,share:double,missing:boolean>"


@dataclass
class TreeEnsemble:
    """Paths of an ensemble: ``tree, leaf, value, splits, visited``. ``strict``: values below a threshold go left, else values up to it."""

    paths: DataFrame
    offset: float = 0.0
    strict: bool = False
    logistic: bool = False
    part: int = PART

    def inside(self, s: Column, x: Column) -> Column:
        within = ((x >= s["lo"]) & (x < s["hi"])) if self.strict else ((x > s["lo"]) & (x <= s["hi"]))
        return F.when(x.isNull() | F.isnan(x), s["missing"]).otherwise(within)

    def parts(self, features: Sequence[str]) -> list[DataFrame]:
        """One-row tables ``_paths`` of at most ``part`` splits or so, features as places in ``features``."""
        place = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
        splits = F.transform("splits", lambda s: s.withField("i", place[s["feature"]]).dropFields("feature"))
        rows = cut_lineage(self.paths.select("tree", "leaf", "value", splits.alias("s")))
        total = rows.agg(F.coalesce(F.sum(F.size("s") + 1), F.lit(0))).first()[0]
        n = max(1, -(-total // self.part))
        part = F.pmod(F.xxhash64("tree", "leaf"), F.lit(n))
        packed = rows.withColumn("_part", part).groupBy("_part").agg(F.collect_list(F.struct("tree", "leaf", "value", "s")).alias("_paths"))
        packed = cut_lineage(packed)
        return [packed.filter(F.col("_part") == i).select("_paths") for i in range(n)]

    def base(self) -> float:
        """The expected margin: every leaf by the share of the training rows that reach it."""
        share = F.aggregate("splits", F.lit(1.0), lambda acc, s: acc * s["share"])
        return float(self.paths.agg(F.coalesce(F.sum(F.col("value") * share), F.lit(0.0))).first()[0]) + self.offset

    def longest(self) -> int:
        return int(self.paths.agg(F.coalesce(F.max(F.size("splits")), F.lit(0))).first()[0])


def tree_ensemble(nodes: DataFrame, offset: float = 0.0, scale: float = 1.0, strict: bool = False, logistic: bool = False, part: int = PART) -> TreeEnsemble:
    """An ensemble from its nodes: ``tree, node, feature, threshold, left, right, missing_left, value, cover``.

    Node 0 is the root; leaves have no feature. A value at the threshold goes
    left, or right if ``strict``; a missing one goes left if ``missing_left``.
    ``cover`` is the number (or weight) of training rows of the node, above zero.
    Leaf values are multiplied by ``scale``, so one over the number of trees
    averages them. The margin is the sum of the leaf values and ``offset``.
    """
    nodes = cut_lineage(nodes.select(
        "tree", "node", "feature", F.col("threshold").cast("double").alias("threshold"), "left", "right",
        F.coalesce("missing_left", F.lit(True)).alias("missing_left"), F.col("value").cast("double").alias("value"), F.col("cover").cast("double").alias("cover"),
    ))
    low, high = float("-inf"), float("inf")
    frontier = nodes.filter("node = 0").withColumns({"path": F.array().cast(f"array<{_SPLIT}>"), "visited": F.array("node")})
    done = []
    while True:
        done.append(frontier.filter("feature IS NULL").select("tree", F.col("node").alias("leaf"), (F.col("value") * scale).alias("value"), "path", "visited"))
        inner = frontier.filter("feature IS NOT NULL")
        if inner.isEmpty():
            break
        bounds = lambda lo, hi, to, missing: F.struct(F.col(to).alias("to"), lo.alias("lo"), hi.alias("hi"), missing.alias("missing"))
        ways = F.array(bounds(F.lit(low), F.col("threshold"), "left", F.col("missing_left")), bounds(F.col("threshold"), F.lit(high), "right", ~F.col("missing_left")))
        steps = inner.select("tree", F.col("feature").alias("f"), F.col("cover").alias("above"), F.col("path").alias("before"), F.col("visited").alias("seen"), F.inline(ways))
        below = nodes.join(steps.withColumnsRenamed({"tree": "t", "to": "at"}), (F.col("tree") == F.col("t")) & (F.col("node") == F.col("at")))
        split = F.struct(F.col("f").alias("feature"), "lo", "hi", (F.col("cover") / F.col("above")).alias("share"), "missing")
        frontier = cut_lineage(below.select(
            *nodes.columns, F.concat("before", F.array(split)).alias("path"), F.concat("seen", F.array("node")).alias("visited"),
        ))
    leaves = reduce(DataFrame.unionByName, done)
    # Splits of one feature on a path are one interval.
    merged = leaves.select("tree", "leaf", F.inline("path")).groupBy("tree", "leaf", "feature").agg(
        F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.product("share").alias("share"), F.bool_and("missing").alias("missing"),
    )
    splits = merged.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi", "share", "missing"))).alias("splits"))
    paths = leaves.drop("path").join(splits, ["tree", "leaf"], "left").withColumn("splits", F.coalesce("splits", F.array().cast(f"array<{_SPLIT}>")))
    return TreeEnsemble(cut_lineage(paths), offset, strict, logistic, part)


def _values(features: Sequence[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in features])


def _fold(df: DataFrame, model: TreeEnsemble, features: Sequence[str], start: Column, add: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """``df`` with ``out``: ``add(sum so far, paths)`` over all parts of the ensemble; only one part is held at a time."""
    kept = [col(c) for c in df.columns]
    rows = df.withColumn("_sum", start)
    parts = model.parts(features)
    for i, part in enumerate(parts):
        rows = rows.crossJoin(F.broadcast(part)).withColumn("_sum", add(F.col("_sum"), F.col("_paths"))).drop("_paths")
        if i + 1 < len(parts):
            rows = cut_lineage(rows)
    return rows.select(*kept, F.col("_sum").alias(out))


def tree_score(df: DataFrame, model: TreeEnsemble, features: Sequence[str], out: str = "p") -> DataFrame:
    """The ensemble's output for every row: the margin, or its logistic value."""
    x = _values(features)
    reached = lambda paths: F.filter(paths, lambda p: F.forall(p["s"], lambda s: model.inside(s, F.get(x, s["i"]))))
    add = lambda total, paths: F.aggregate(reached(paths), total, lambda acc, p: acc + p["value"])
    done = _fold(df, model, features, F.lit(float(model.offset)), add, "_margin")
    margin = F.col("_margin")
    return done.select(*[col(c) for c in df.columns if c != out], (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) if model.logistic else margin).alias(out))


def reached_leaves(df: DataFrame, model: TreeEnsemble, features: Sequence[str]) -> DataFrame:
    """``tree, leaf, n``: rows of ``df`` that end in each leaf; leaves without a row are missing."""
    x = _values(features)
    parts = []
    for part in model.parts(features):
        hit = F.filter("_paths", lambda p: F.forall(p["s"], lambda s: model.inside(s, F.get(x, s["i"]))))
        parts.append(df.crossJoin(F.broadcast(part)).select(F.inline(F.transform(hit, lambda p: F.struct(p["tree"].alias("tree"), p["leaf"].alias("leaf"))))))
    return reduce(DataFrame.unionByName, parts).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))


def with_covers(nodes: DataFrame, df: DataFrame, features: Sequence[str], strict: bool = False) -> DataFrame:
    """``nodes`` with ``cover`` counted on ``df`` (at least one, so that no share is zero)."""
    model = tree_ensemble(nodes.withColumn("cover", F.lit(1.0)), strict=strict)
    counts = reached_leaves(df, model, features)
    seen = model.paths.join(counts, ["tree", "leaf"]).select("tree", F.explode("visited").alias("node"), "n").groupBy("tree", "node").agg(F.sum("n").alias("_n"))
    return nodes.drop("cover").join(seen, ["tree", "node"], "left").withColumn("cover", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).cast("double")).drop("_n")


def tree_attribution(df: DataFrame, model: TreeEnsemble, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Tall attribution table: key, feature, x, value; values of a row and ``model.base()`` add up to its margin.

    Missing values go the way their node sends them. Rows may repeat; features
    that no path asks for get 0.
    """
    x = _values(features)
    order = max(1, -(-model.longest() // 2))
    at, weight = np.polynomial.legendre.leggauss(order)
    nodes = F.array(*[F.struct(F.lit(float((t + 1) / 2)).alias("t"), F.lit(float(w / 2)).alias("w")) for t, w in zip(at, weight)])

    def path_gains(p: Column) -> Column:
        met = F.transform(p["s"], lambda s: F.struct(
            s["i"].alias("i"), s["share"].alias("z"), (F.when(model.inside(s, F.get(x, s["i"])), 1.0).otherwise(0.0) - s["share"]).alias("d"),
        ))
        # A one-element array names a value that is used several times.
        return F.flatten(F.transform(F.array(met), lambda m: F.flatten(F.transform(
            F.array(F.transform(nodes, lambda q: q["w"] * F.aggregate(m, F.lit(1.0), lambda acc, g: acc * (g["z"] + q["t"] * g["d"])))),
            lambda products: F.transform(m, lambda g: F.struct(
                g["i"].alias("i"),
                (p["value"] * g["d"] * F.aggregate(
                    F.zip_with(products, nodes, lambda v, q: v / (g["z"] + q["t"] * g["d"])), F.lit(0.0), lambda acc, v: acc + v,
                )).alias("v"),
            )),
        ))))

    def add(total: Column, paths: Column) -> Column:
        return F.aggregate(paths, total, lambda acc, p: F.aggregate(
            path_gains(p), acc, lambda sums, g: F.transform(sums, lambda v, i: F.when(i == g["i"], v + g["v"]).otherwise(v)),
        ))

    zero = F.array(*[F.lit(0.0) for _ in features])
    done = _fold(df.select(*[col(c) for c in dict.fromkeys([*key, *features])]), model, features, zero, add, "_gains")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("x"), F.get("_gains", F.lit(i)).alias("value")) for i, c in enumerate(features)])
    return done.select(*map(col, key), F.inline(cells))
