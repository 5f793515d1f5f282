"""Feature importance, attribution summaries and representative rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from ..functions.cumulative import cumulative_counts, exact_quantiles, running_totals
from ..functions.findings import Rule, apply_rules, health
from .performance import _auc
from .robustness import perturbed
from .scoring import Model, score

THRESHOLDS = {
    "top1_critical": 0.50,
    "top1_warning": 0.35,
    "top3_critical": 0.80,
    "top3_warning": 0.65,
    "agreement_critical": 0.10,
    "agreement_warning": 0.30,
    "identifier_share": 0.15,
    "constant_attribution": 0.01,
}
PENALTIES = {"CRITICAL": 25, "HIGH": 15, "WARNING": 5, "MEDIUM": 3, "LOW": 1}
# Name patterns of identifiers.
IDENTIFIER_PATTERN = "(_id$)|(^id$)|uuid|hash|guid|token"


def shuffled(df: DataFrame, cols: Sequence[str], key: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """Rows with one donor row per repeat: ``_d0``, ``_d1``, ... hold the donors' ``cols``.

    All rows are ranked by a hash of their key; in each repeat the donor is the
    row whose rank is a seeded offset ahead, cyclically. That is a permutation of
    the whole table at every size. Ranks are distributed running totals, donors
    come by an equi-join on the rank. ``key`` must be unique.
    """
    keys = [col(k) for k in key]
    ordered = df.withColumns({"_order": F.struct(F.xxhash64(*keys, F.lit(seed)).alias("h"), *keys), "_one": F.lit(1), "_all": F.lit(0)})
    ranked = running_totals(ordered, ["_all"], "_order", ["_one"]).withColumnsRenamed({"lt__one": "_rank", "tot__one": "_n"}).drop("_order", "_one", "_all")
    donors = ranked.select(F.col("_rank").alias("_from"), F.struct(*[col(c).cast("double").alias(c) for c in cols]).alias("_d"))
    out = ranked
    for i in range(repeats):
        offset = F.pmod(F.xxhash64(F.lit(seed), F.lit(i)), F.greatest(F.col("_n") - 1, F.lit(1))) + 1
        out = out.withColumn("_from", F.pmod(F.col("_rank") + offset, F.col("_n"))).join(donors, "_from").drop("_from").withColumnRenamed("_d", f"_d{i}")
    return out.drop("_rank", "_n")


def permutation_importance(
    df: DataFrame, model: Model, y: str, features: Sequence[str], key: Sequence[str], repeats: int = 5, seed: int = 42, loader: bool = False
) -> DataFrame:
    """Mean and deviation of the ROC-AUC lost when one feature is shuffled; ranked."""
    base = shuffled(df, features, key, repeats, seed)
    variants = [({"feature": F.lit("_none"), "repeat": F.lit(0)}, {})]
    for i in range(repeats):
        for f in features:
            variants.append(({"feature": F.lit(f), "repeat": F.lit(i)}, {f: F.col(f"_d{i}").getField(f)}))
    rows = score(perturbed(base, features, variants, [y]), model, features, "_p", loader)
    table = cumulative_counts(
        rows, ["feature", "repeat"], "_p", {"pos": (col(y) == 1).cast("long"), "neg": (col(y) != 1).cast("long")}
    )
    auc = table.groupBy("feature", "repeat").agg(F.coalesce(_auc(), F.lit(0.5)).alias("auc"))
    origin = auc.filter(F.col("feature") == "_none").select(F.col("auc").alias("_auc0"))
    drops = auc.filter(F.col("feature") != "_none").join(F.broadcast(origin)).withColumn("drop", F.col("_auc0") - F.col("auc"))
    per = drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"), F.count(F.lit(1)).alias("repeats")
    )
    # One row per feature: the window is as small as the schema.
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature")))


def global_attribution(attr: DataFrame, slices: int = 256) -> DataFrame:
    """Mean |v|, mean v, median |v|, sign rates, share and rank per feature."""
    v = F.col("value")
    per = attr.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg(F.abs(v)).alias("mean_abs"),
        F.avg(v).alias("mean_signed"),
        F.avg((v > 0).cast("double")).alias("positive_rate"),
        F.avg((v < 0).cast("double")).alias("negative_rate"),
    )
    sizes = attr.select("feature", F.abs(v).alias("size"))
    table = cumulative_counts(sizes, ["feature"], "size", {"k": F.lit(1)}, slices)
    q = exact_quantiles(table, ["feature"], "size", "k", {"median_abs": 0.5}).drop("n")
    whole = Window.partitionBy()
    return per.join(F.broadcast(q), "feature").select(
        "feature", "n", "mean_abs", "mean_signed", "median_abs", "positive_rate", "negative_rate",
        F.coalesce(F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(whole)), F.lit(0.0)).alias("share"),
        F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")).alias("rank"),
    )


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman correlation of two rankings; NULL under three common features."""
    both = a.select("feature", F.col("rank").alias("ra")).join(b.select("feature", F.col("rank").alias("rb")), "feature")
    return both.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.when(F.count(F.lit(1)) >= 3, F.corr(F.col("ra").cast("double"), F.col("rb").cast("double"))).alias("spearman"),
    )


def concentration(importance: DataFrame, value: str = "mean_abs") -> DataFrame:
    """Shares of the top 1, 3, 5 and 10 features and the normalised entropy."""
    v = F.greatest(F.col(value), F.lit(0.0))
    whole = Window.partitionBy()
    order = Window.orderBy(F.desc(value), "feature")
    share = F.try_divide(v, F.sum(v).over(whole))
    rows = importance.select(share.alias("share"), F.row_number().over(order).alias("r"))
    s = F.col("share")
    top = lambda k: F.coalesce(F.sum(F.when(F.col("r") <= k, s)), F.lit(0.0)).alias(f"top{k}_share")
    entropy = F.sum(F.when(s > 0, -s * F.log(s)))
    widest = F.when(F.count(F.lit(1)) > 1, F.log(F.count(F.lit(1)).cast("double"))).otherwise(F.lit(1.0))
    return rows.agg(top(1), top(3), top(5), top(10), F.coalesce(entropy / widest, F.lit(1.0)).alias("entropy"))


def local_examples(scored: DataFrame, attr: DataFrame, y: str, p: str, key: Sequence[str], top: int = 10, t: float = 0.5) -> DataFrame:
    """Representative rows with their strongest contributions.

    Picks: highest and lowest probability, best true positive and true negative,
    closest to the threshold; a row picked twice keeps its first role.
    """
    keys = [col(k) for k in key]
    prob, pos = col(p), col(y) == 1
    who = F.struct(*keys)
    shown = F.struct(*[c.alias(k) for c, k in zip(keys, key)], prob.alias("p"), col(y).cast("int").alias("y"))

    def best(order, when=None):
        rank = F.struct(order, who)
        return F.min_by(shown, rank if when is None else F.when(when, rank))

    picks = scored.agg(
        best(-prob).alias("MAX_PROBABILITY"),
        best(prob).alias("MIN_PROBABILITY"),
        best(-prob, pos & (prob >= t)).alias("TRUE_POSITIVE"),
        best(prob, ~pos & (prob < t)).alias("TRUE_NEGATIVE"),
        best(F.abs(prob - t)).alias("BORDERLINE"),
    )
    roles = ["MAX_PROBABILITY", "MIN_PROBABILITY", "TRUE_POSITIVE", "TRUE_NEGATIVE", "BORDERLINE"]
    cells = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(r).alias("role"), F.col(r).alias("row")) for i, r in enumerate(roles)])
    chosen = picks.select(F.inline(cells)).filter(F.col("row").isNotNull())
    first = chosen.groupBy(*[F.col(f"row.{k}").alias(k) for k in key]).agg(
        F.min_by("role", "o").alias("role"), F.first("row.p").alias("p"), F.first("row.y").alias("y")
    )
    # At most five rows on the broadcast side.
    hit = attr.join(F.broadcast(first), list(key))
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("value")), "feature")
    return hit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select(
        "role", *key, "p", "y", "place", "feature", "x", "value",
        F.when(F.col("value") >= 0, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("direction"),
    )


def explain_findings(
    importance: DataFrame, agreement: DataFrame | None = None, spread: DataFrame | None = None, thresholds: dict | None = None
) -> DataFrame:
    """``importance`` as from global_attribution; ``spread`` holds feature, std for the constant check."""
    t = {**THRESHOLDS, **(thresholds or {})}
    c1, c3 = F.col("top1_share"), F.col("top3_share")
    out = apply_rules(concentration(importance), "EXPLAINABILITY", [
        Rule("dominant_critical", "HIGH", c1 >= t["top1_critical"], "top1_share", c1, t["top1_critical"], "check the leading feature for leakage"),
        Rule("dominant_elevated", "WARNING", (c1 >= t["top1_warning"]) & (c1 < t["top1_critical"]), "top1_share", c1, t["top1_warning"],
             "watch the leading feature"),
        Rule("concentrated_critical", "HIGH", c3 >= t["top3_critical"], "top3_share", c3, t["top3_critical"], "few features carry the model"),
        Rule("concentrated_elevated", "WARNING", (c3 >= t["top3_warning"]) & (c3 < t["top3_critical"]), "top3_share", c3, t["top3_warning"],
             "watch the leading features"),
    ])
    out = out.unionByName(apply_rules(importance, "EXPLAINABILITY", [
        Rule("identifier_reliance", "HIGH",
             (F.col("rank") <= 3) & F.lower("feature").rlike(IDENTIFIER_PATTERN) & (F.col("share") >= t["identifier_share"]),
             "share", F.col("share"), t["identifier_share"], "drop identifiers from the inputs")], F.col("feature")))
    if agreement is not None:
        s = F.col("spearman")
        out = out.unionByName(apply_rules(agreement, "EXPLAINABILITY", [
            Rule("disagreement_critical", "HIGH", s < t["agreement_critical"], "spearman", s, t["agreement_critical"], "the two rankings differ"),
            Rule("disagreement_elevated", "WARNING", (s >= t["agreement_critical"]) & (s < t["agreement_warning"]), "spearman", s,
                 t["agreement_warning"], "compare the two rankings")]))
    if spread is not None:
        both = importance.join(F.broadcast(spread), "feature")
        still = F.coalesce(F.col("std"), F.lit(0.0)) == 0
        out = out.unionByName(apply_rules(both, "EXPLAINABILITY", [
            Rule("constant_attributed", "WARNING", still & (F.col("mean_abs") > t["constant_attribution"]), "mean_abs", F.col("mean_abs"),
                 t["constant_attribution"], "a constant input should not matter")], F.col("feature")))
    return out


def explain_report(findings: DataFrame) -> DataFrame:
    return health(findings, PENALTIES)


def importance_shares(importance: DataFrame, value: str = "importance_mean") -> DataFrame:
    """Give a permutation ranking the shape of an attribution ranking, for models without attributions."""
    v = F.greatest(F.col(value), F.lit(0.0))
    return importance.select(
        "feature", v.alias("mean_abs"), F.col(value).alias("mean_signed"), v.alias("median_abs"),
        ratio(v, F.sum(v).over(Window.partitionBy()), 0).alias("share"), "rank",
    )
