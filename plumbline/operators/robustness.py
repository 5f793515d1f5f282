"""Perturbation stress: noise, boundary search, missing values, subgroups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, count_if, gaussian, ratio, uniform
from ..functions.cumulative import cumulative_counts, exact_quantiles
from ..functions.findings import Rule, apply_rules, health
from .performance import _auc
from .scoring import LinearModel, Model, score
from .trees import TreeEnsemble

# Search distances in feature scales, noise and drop-out levels.
FACTORS = [0.05, 0.10, 0.20, 0.35, 0.50, 0.75, 1.0, 1.5, 2.0, 3.0]
NOISE_LEVELS = [0.01, 0.05, 0.10]
MISSING_LEVELS = [0.05, 0.10, 0.20]
THRESHOLDS = {
    "flip_warning": 0.05,
    "flip_critical": 0.20,
    "shift_warning": 0.05,
    "shift_critical": 0.10,
    "gap_warning": 0.05,
    "gap_critical": 0.10,
    "distance_warning": 0.30,
    "distance_critical": 0.15,
}
PENALTIES = {"CRITICAL": 25, "HIGH": 15, "WARNING": 5, "MEDIUM": 3, "LOW": 1}


def feature_scales(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample deviation, else 1.

    An IQR fallback between the two can never apply: a deviation of zero means that
    all values are equal, and then the IQR is zero as well.
    """
    from .quality import numeric_summary

    return numeric_summary(df, cols).select("feature", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("scale"))


def scale_map(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The scales as constants: one number per feature."""
    return {r["feature"]: float(r["scale"]) for r in feature_scales(df, cols).collect()}


def perturbed(df: DataFrame, features: Sequence[str], variants: Sequence[tuple[dict[str, Column], dict[str, Column]]], keep: Sequence[str]) -> DataFrame:
    """Every row times every variant. A variant is (label columns, replaced features)."""
    cells = []
    for labels, changes in variants:
        parts = [c.alias(n) for n, c in labels.items()]
        parts += [changes.get(f, col(f).cast("double")).cast("double").alias(f) for f in features]
        cells.append(F.struct(*parts))
    return df.select(*[col(k) for k in keep], F.inline(F.array(*cells)))


def _base(df: DataFrame, model: Model, features: Sequence[str], loader: bool) -> DataFrame:
    return score(df, model, features, "_p0", loader)


def _stress(df, model, features, variants, keep, label, y, t, loader) -> DataFrame:
    """Score all variants in one stage and summarise flips, shifts and metrics per label."""
    names = [label] if isinstance(label, str) else list(label)
    base = _base(df, model, features, loader)
    rows = score(perturbed(base, features, variants, ["_p0", *keep]), model, features, "_p1", loader)
    rows = rows.withColumn("shift", F.abs(F.col("_p1") - F.col("_p0"))).withColumn("flip", (F.col("_p1") >= t) != (F.col("_p0") >= t))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if("flip").alias("flips"),
        F.avg("shift").alias("mean_shift"),
        F.max("shift").alias("max_shift"),
    ]
    if y:
        hit, pos = F.col("_p1") >= t, col(y) == 1
        aggs += [F.count_if(hit == pos).alias("_right"), F.count_if(hit & pos).alias("_tp"), F.count_if(hit & ~pos).alias("_fp"),
                 F.count_if(~hit & pos).alias("_fn")]
    out = rows.groupBy(*names).agg(*aggs)
    middle = cumulative_counts(rows, names, "shift", {"k": F.lit(1)})
    out = out.join(F.broadcast(exact_quantiles(middle, names, "shift", "k", {"median_shift": 0.5}).drop("n")), names)
    shown = [*names, "n", "flips", ratio(F.col("flips"), F.col("n"), 0).alias("flip_rate"), "mean_shift", "median_shift", "max_shift"]
    if y:
        table = cumulative_counts(rows, names, "_p1", {"pos": (col(y) == 1).cast("long"), "neg": (col(y) != 1).cast("long")})
        out = out.join(F.broadcast(table.groupBy(*names).agg(_auc().alias("roc_auc"))), names)
        two = F.col("_tp") * 2
        shown += [ratio(F.col("_right"), F.col("n")).alias("accuracy"), ratio(two, two + F.col("_fp") + F.col("_fn"), 0).alias("f1"), "roc_auc"]
    return out.select(*shown)


def jitter_sensitivity(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], y: str | None = None,
    levels: Sequence[float] = NOISE_LEVELS, seed: int = 42, t: float = 0.5, loader: bool = False, scales: dict[str, float] | None = None,
) -> DataFrame:
    """Gaussian noise on all features at several multiples of the scale; the same draw per cell at every level."""
    scales = scales or scale_map(df, features)
    noise = {f: gaussian(*[col(k) for k in key], f, seed) for f in features}
    variants = [
        ({"level": F.lit(float(v))}, {f: col(f).cast("double") + noise[f] * (v * scales[f]) for f in features}) for v in levels
    ]
    return _stress(df, model, features, variants, [y] if y else [], "level", y, t, loader)


def feature_sensitivity(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], level: float = 0.05, seed: int = 42,
    t: float = 0.5, loader: bool = False, scales: dict[str, float] | None = None,
) -> DataFrame:
    """Noise on one feature at a time, ranked by flip rate, then mean shift."""
    scales = scales or scale_map(df, features)
    variants = [
        ({"feature": F.lit(f)}, {f: col(f).cast("double") + gaussian(*[col(k) for k in key], f, seed) * (level * scales[f])})
        for f in features
    ]
    out = _stress(df, model, features, variants, [], "feature", None, t, loader)
    return out.orderBy(F.desc("flip_rate"), F.desc("mean_shift"), "feature")


def search_batch(predict, x: pd.DataFrame, factors: Sequence[float], scales: Sequence[float], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the feature (-1: none) and distance (NaN: none) of the smallest flipping move of each row of a batch."""
    def positive(rows: pd.DataFrame) -> np.ndarray:
        got = np.asarray(predict(rows), dtype=float)
        return got[:, 1] if got.ndim == 2 else got

    which, distance = np.full(len(x), -1), np.full(len(x), np.nan)
    if len(x):
        up = positive(x) >= t
        open_ = np.arange(len(x))
        for v in sorted(factors):
            for i, (name, scale) in enumerate(zip(x.columns, scales)):
                if not len(open_):
                    return which, distance
                rows = x.iloc[np.concatenate([open_, open_])].reset_index(drop=True)
                rows[name] += np.repeat([v * scale, -v * scale], len(open_))
                crossed = ((positive(rows) >= t).reshape(2, -1) != up[open_]).any(axis=0)
                which[open_[crossed]], distance[open_[crossed]] = i, v
                open_ = open_[~crossed]
    return which, distance


def _searched(df: DataFrame, model, features: list[str], key: list[str], factors: list[float], scales: list[float], t: float, loader: bool) -> DataFrame:
    keys = [f.name for f in df.schema if f.name in set(key)]
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)],
                           T.StructField("feature", T.StringType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model() if loader else model
        for batch in batches:
            x = batch[[f"x{i}" for i in range(len(features))]].astype(float).set_axis(features, axis=1)
            which, distance = search_batch(predict, x, factors, scales, t)
            out = batch[[f"k{i}" for i in range(len(keys))]].copy()
            out["feature"] = [features[i] if i >= 0 else None for i in which]
            out["distance"] = pd.Series(distance, index=out.index, dtype="float64").where(which >= 0, None)
            yield out

    cells = [col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    found = df.select(*cells).mapInPandas(run, schema)
    distance = F.when(F.col("feature").isNotNull(), F.col("distance")).alias("distance")
    return found.select(*[F.col(f"k{keys.index(k)}").alias(k) for k in key], "feature", distance)


def boundary_distances(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], factors: Sequence[float] = FACTORS,
    t: float = 0.5, loader: bool = False, scales: dict[str, float] | None = None,
) -> DataFrame:
    """Per row the smallest single-feature move that flips the decision: key, feature, distance (NULL if none).

    Nothing is shuffled. A linear model is searched inside the row. A Python model
    is asked in the Arrow batches of the rows, factor by factor and feature by
    feature, and only for rows that no nearer move has flipped. Of several features
    at the same distance the first one counts.
    """
    scales = scales or scale_map(df, features)
    if isinstance(model, LinearModel):
        # A step moves the margin by coefficient x step; the margin itself is computed once per row.
        limit = math.log(t / (1 - t)) if model.logistic else t
        base = df.select(*[col(k) for k in key], *[col(f).isNotNull().alias(f"_has{i}") for i, f in enumerate(features)], model.margin().alias("_z"))
        moves = []
        for v in factors:
            for i, f in enumerate(features):
                reach = abs(model.coef.get(f, 0.0)) * v * scales[f]
                crosses = F.when(F.col("_z") >= limit, F.col("_z") - reach < limit).otherwise(F.col("_z") + reach >= limit)
                # Moves are numbered from the nearest on, so the smallest number is the answer.
                moves.append(F.when(F.col(f"_has{i}") & crosses, len(moves)))
        nearest = base.select(*[col(k) for k in key], F.coalesce(*moves).alias("_move"))
        return nearest.select(
            *[col(k) for k in key],
            F.get(F.array(*[F.lit(f) for f in features]), F.col("_move") % len(features)).alias("feature"),
            F.get(F.array(*[F.lit(float(v)) for v in factors]), F.floor(F.col("_move") / len(features)).cast("int")).alias("distance"),
        )
    if not isinstance(model, TreeEnsemble):
        return _searched(df, model, list(features), list(key), list(factors), [float(scales[f]) for f in features], t, loader)
    variants = []
    for i, f in enumerate(features):
        for v in factors:
            for sign in (1.0, -1.0):
                labels = {"feature": F.lit(f), "_order": F.lit(i), "factor": F.lit(float(v))}
                variants.append((labels, {f: col(f).cast("double") + sign * v * scales[f]}))
    base = _base(df, model, features, loader)
    rows = score(perturbed(base, features, variants, ["_p0", *key]), model, features, "_p1", loader)
    flipped = (F.col("_p1") >= t) != (F.col("_p0") >= t)
    best = F.min(F.when(flipped, F.struct("factor", "_order", "feature"))).alias("_best")
    return rows.groupBy(*[col(k) for k in key]).agg(best).select(
        *[col(k) for k in key], F.col("_best.feature").alias("feature"), F.col("_best.factor").alias("distance")
    )


def _distance_counts(distances: DataFrame, key: Column) -> DataFrame:
    """Rows per distance, at most one per search factor; rows without a flip weigh nothing.

    No filter on the distance: it would be pushed into the search and evaluated there again.
    """
    counts = distances.groupBy(key.alias("scope"), "distance").agg(F.count(F.lit(1)).alias("k"))
    return _tiny_cumulative(counts.withColumn("k", F.when(F.col("distance").isNull(), F.lit(0)).otherwise(F.col("k"))))


def boundary_summary(distances: DataFrame) -> DataFrame:
    """Share of rows that can be flipped; minimum, median and maximum distance."""
    counts = _distance_counts(distances, F.lit("all"))
    middle = exact_quantiles(counts, ["scope"], "distance", "k", {"median_distance": 0.5})
    out = distances.agg(
        F.count(F.lit(1)).alias("n"), F.count("distance").alias("flipped"),
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
    )
    return out.join(F.broadcast(middle.select("median_distance")), how="left").withColumn("flip_rate", ratio(F.col("flipped"), F.col("n"), 0))


def boundary_features(distances: DataFrame) -> DataFrame:
    q = exact_quantiles(_distance_counts(distances, F.col("feature")), ["scope"], "distance", "k", {"median_distance": 0.5})
    return q.select(F.col("scope").alias("feature"), F.col("n").alias("flips"), "median_distance").orderBy(F.desc("flips"), "feature")


def _tiny_cumulative(counts: DataFrame) -> DataFrame:
    """Running totals of a table with at most (features x factors) rows."""
    from pyspark.sql import Window

    below = Window.partitionBy("scope").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("lt_k", F.coalesce(F.sum("k").over(below), F.lit(0))).withColumn(
        "tot_k", F.sum("k").over(Window.partitionBy("scope"))
    )


def missingness_stress(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], y: str | None = None,
    levels: Sequence[float] = MISSING_LEVELS, seed: int = 42, t: float = 0.5, loader: bool = False,
) -> DataFrame:
    """Cells go missing at random; a cell missing at a low level is also missing at higher ones."""
    draw = {f: uniform(*[col(k) for k in key], f, seed) for f in features}
    variants = [
        ({"level": F.lit(float(v))}, {f: F.when(draw[f] >= v, col(f).cast("double")) for f in features}) for v in levels
    ]
    return _stress(df, model, features, variants, [y] if y else [], "level", y, t, loader)


def subgroup_robustness(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], attr: str, level: float = 0.05,
    seed: int = 42, t: float = 0.5, loader: bool = False, scales: dict[str, float] | None = None,
) -> DataFrame:
    """Flip rate under noise per subgroup."""
    scales = scales or scale_map(df, features)
    base = _base(df.filter(col(attr).isNotNull()), model, features, loader)
    moved = {f: col(f).cast("double") + gaussian(*[col(k) for k in key], f, seed) * (level * scales[f]) for f in features}
    rows = score(perturbed(base, features, [({"grp": col(attr).cast("string")}, moved)], ["_p0"]), model, features, "_p1", loader)
    out = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_p0") >= t).cast("double")).alias("positive_rate"),
        count_if((F.col("_p1") >= t) != (F.col("_p0") >= t)).alias("flips"),
        F.avg(F.abs(F.col("_p1") - F.col("_p0"))).alias("mean_shift"),
    )
    return out.withColumn("flip_rate", ratio(F.col("flips"), F.col("n")))


def robustness_gap(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.when(F.count(F.lit(1)) >= 2, F.max("flip_rate") - F.min("flip_rate")).alias("gap"),
    )


def robustness_findings(
    jitter: DataFrame, distances: DataFrame, groups: DataFrame | None = None, thresholds: dict | None = None
) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    flip, shift, d = F.col("flip_rate"), F.col("mean_shift"), F.col("median_distance")
    out = apply_rules(jitter.filter(F.abs(F.col("level") - 0.05) < 1e-4), "ROBUSTNESS", [
        Rule("noise_critical", "CRITICAL", flip >= t["flip_critical"], "flip_rate", flip, t["flip_critical"], "regularise, coarsen the inputs"),
        Rule("noise_elevated", "WARNING", (flip >= t["flip_warning"]) & (flip < t["flip_critical"]), "flip_rate", flip, t["flip_warning"],
             "watch small input changes"),
        Rule("shift_high", "HIGH", shift >= t["shift_critical"], "mean_shift", shift, t["shift_critical"], "smooth the model response"),
        Rule("shift_elevated", "WARNING", (shift >= t["shift_warning"]) & (shift < t["shift_critical"]), "mean_shift", shift,
             t["shift_warning"], "watch the probability response"),
    ])
    close = (d <= t["distance_critical"]) & (flip >= 0.20)
    out = out.unionByName(apply_rules(boundary_summary(distances), "ROBUSTNESS", [
        Rule("boundary_close", "HIGH", close, "median_distance", d, t["distance_critical"], "many rows sit at the boundary"),
        Rule("boundary_near", "WARNING", ~close & (d <= t["distance_warning"]), "median_distance", d, t["distance_warning"],
             "review rows near the boundary")]))
    if groups is not None:
        gap = F.col("gap")
        out = out.unionByName(apply_rules(robustness_gap(groups), "ROBUSTNESS", [
            Rule("gap_high", "HIGH", gap >= t["gap_critical"], "gap", gap, t["gap_critical"], "noise hits some groups harder"),
            Rule("gap_elevated", "WARNING", (gap >= t["gap_warning"]) & (gap < t["gap_critical"]), "gap", gap, t["gap_warning"],
                 "compare the groups under noise")]))
    return out


def robustness_report(findings: DataFrame) -> DataFrame:
    return health(findings, PENALTIES)
