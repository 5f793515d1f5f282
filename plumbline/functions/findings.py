"""Findings and health scores: rules are plain column predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clamp


@dataclass
class Rule:
    code: str
    severity: str | Column
    when: Column
    metric: str
    value: Column
    threshold: float | Column | None
    advice: str


def _lit(v, kind: str) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast(kind)


def apply_rules(df: DataFrame, module: str, rules: list[Rule], feature: Column | None = None) -> DataFrame:
    """All rules in one pass: a row per rule that fires on a row of ``df``."""
    cells = [
        F.when(
            r.when,
            F.struct(
                F.lit(r.code).alias("code"),
                _lit(r.severity, "string").alias("severity"),
                F.lit(r.metric).alias("metric"),
                r.value.cast("double").alias("value"),
                _lit(r.threshold, "double").alias("threshold"),
                F.lit(r.advice).alias("advice"),
            ),
        )
        for r in rules
    ]
    who = F.lit(None).cast("string") if feature is None else feature.cast("string")
    return df.select(
        F.lit(module).alias("module"),
        who.alias("feature"),
        F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())),
    )


def health(findings: DataFrame, penalties: dict[str, float], gate: Column | None = None) -> DataFrame:
    """Score 100 minus severity penalties; passed at 70 with nothing critical."""
    cost = F.lit(0.0)
    for severity, points in penalties.items():
        cost = F.when(F.col("severity") == severity, F.lit(float(points))).otherwise(cost)
    out = findings.agg(
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("penalty"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.count(F.lit(1)).alias("n_findings"),
    )
    score = F.round(clamp(F.lit(100.0) - F.col("penalty"), 0, 100), 1)
    ok = (score >= 70) & (F.col("n_critical") == 0)
    return out.select(
        "n_findings",
        "n_critical",
        score.alias("health_score"),
        (ok if gate is None else ok & gate).alias("passed"),
    )
