"""Scoring and attribution with a user-supplied model.

A model is a ``LinearModel`` (pure column arithmetic), a ``TreeEnsemble`` (array
expressions over its paths; both stay in the JVM) or any function ``pandas.DataFrame -> array of positive-class probabilities``,
which runs in Arrow batches inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, finite
from ..functions.cumulative import melt
from .trees import TreeEnsemble, tree_attribution, tree_score


@dataclass
class LinearModel:
    """Logistic (or plain linear) model; missing inputs count as the training mean, or 0."""

    coef: dict[str, float]
    intercept: float = 0.0
    logistic: bool = True
    means: dict[str, float] = field(default_factory=dict)

    def margin(self, changes: dict[str, Column] | None = None) -> Column:
        z = F.lit(float(self.intercept))
        for name, w in self.coef.items():
            x = (changes or {}).get(name, col(name).cast("double"))
            z = z + F.coalesce(x, F.lit(float(self.means.get(name, 0.0)))) * float(w)
        return z

    def column(self, changes: dict[str, Column] | None = None) -> Column:
        """Probability as a column, optionally with some inputs replaced."""
        z = self.margin(changes)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if self.logistic else z


Model = LinearModel | TreeEnsemble | Callable[[pd.DataFrame], "object"]


def score(df: DataFrame, model: Model, features: Sequence[str], out: str = "p", loader: bool = False) -> DataFrame:
    """Add the positive-class probability. With ``loader`` the callable returns the scoring
    function, and is called once per task, so a large model is loaded once, not per batch."""
    if isinstance(model, LinearModel):
        return df.withColumn(out, model.column())
    if isinstance(model, TreeEnsemble):
        return tree_score(df, model, features, out)
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = model() if loader else model
        for batch in batches:
            got = predict(batch[names])
            shape = getattr(got, "shape", ())
            if len(shape) == 2:
                got = got[:, 1]
            yield pd.Series(got, index=batch.index, dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, T.DoubleType())
    return df.withColumn(out, udf(F.struct(*[col(c).cast("double").alias(c) for c in names])))


def attribute(
    df: DataFrame, explainer: LinearModel | TreeEnsemble | Callable[[pd.DataFrame], pd.DataFrame], features: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Tall attribution table: key, feature, x, value.

    For a linear model the attribution is exact: coefficient x (value - mean);
    for a tree ensemble it is the path-dependent Shapley value of the margin.
    Otherwise ``explainer`` maps a batch of features to one column per feature.
    """
    names = list(features)
    if isinstance(explainer, TreeEnsemble):
        return tree_attribution(df, explainer, names, key)
    if isinstance(explainer, LinearModel):
        means = explainer.means or {
            r["feature"]: r["mean"] for r in _means(df, names).collect()
        }
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    finite(col(c)).alias("x"),
                    ((F.coalesce(finite(col(c)), F.lit(float(means[c]))) - float(means[c])) * float(explainer.coef.get(c, 0.0))).alias("value"),
                )
                for c in names
            ]
        )
        return df.select(*map(col, key), F.inline(cells))
    keys = [f for f in df.schema if f.name in set(key)]
    schema = T.StructType([*keys, *[T.StructField(f"a{i}", T.DoubleType()) for i in range(len(names))],
                           *[T.StructField(f"x{i}", T.DoubleType()) for i in range(len(names))]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = explainer(batch[names])
            out = batch[[k.name for k in keys]].copy()
            for i, c in enumerate(names):
                out[f"a{i}"] = got[c].to_numpy(dtype=float)
                out[f"x{i}"] = batch[c].to_numpy(dtype=float)
            yield out

    wide = df.select(*[col(k.name) for k in keys], *[col(c).cast("double").alias(c) for c in names if c not in set(key)]).mapInPandas(run, schema)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"x{i}").alias("x"), F.col(f"a{i}").alias("value")) for i, c in enumerate(names)])
    return wide.select(*[col(k.name) for k in keys], F.inline(cells))


def _means(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return melt(df, {c: finite(col(c)) for c in names}).groupBy("feature").agg(F.avg("value").alias("mean"))
