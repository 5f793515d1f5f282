"""Language identification: words first, then shorter and shorter character n-grams.

The model is fitted on a bounded sample of labelled rows: per language the
``FIT_ROWS`` rows that come first in hash order. Spark counts the words and the
character n-grams of the sample; the tables, bounded with the sample, are
broadcast. A text is scored word by word: a known word adds its log frequency in
every language; an unknown word backs off to its longest n-grams of which any is
known, down to single characters, and adds their mean log frequency.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.llm.storage import stored

FIT_ROWS = 2000  # labelled rows per language
MIN_COUNT = 2  # of a word or n-gram in the sample, over all languages
WORD = 0  # the order of whole words
ORDERS = (4, 3, 2, 1)
MEMORY = 200_000  # scores of unknown words that a task remembers
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@F.pandas_udf(ArrayType(StringType()))
def _words_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([words_of(t) for t in part])


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``rows(key, text, lang)`` to at most ``fit_rows`` rows of each language, first in hash order of the key.

    Rows without a language are left out. A language's rows are first thinned by
    their hash to about twice the wanted number (and a thousand more), so the
    ranking meets a bounded number of rows however many carry the label.
    """
    known = rows.filter("lang is not null").withColumn("h", F.xxhash64("key", F.lit(11)))
    share = known.groupBy("lang").agg((F.lit(2.0 * fit_rows + 1000) / F.count("*")).alias("share"))
    near = known.join(F.broadcast(share), "lang").filter(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("share"))  # one row a language
    order = Window.partitionBy("lang").orderBy("h", "key")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= fit_rows).select("lang", "text")


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, min_count: int = MIN_COUNT) -> "Model":
    """Fit on ``rows(key, text, lang)``; words and n-grams are counted by Spark, and the counts of the bounded sample collected."""
    words = sample(rows, fit_rows).select("lang", F.explode(_words_udf("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = stored(words)
    langs = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    piece = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("gram"))

    def pieces(k: int) -> Column:
        padded = F.concat(F.lit(" "), F.col("word"), F.lit(" ")) if k > 1 else F.col("word")
        last = F.length(padded) - (k - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: piece(k, F.substr(padded, i, F.lit(k))))).otherwise(F.array().cast("array<struct<k:int,gram:string>>"))

    grams_of = F.concat(F.array(piece(WORD, F.col("word"))), *[pieces(k) for k in ORDERS])
    per = words.select("lang", "n", F.inline(grams_of)).groupBy("k", "gram")
    counts = per.agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)], F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= min_count).toArrow()
    table = np.column_stack([found[f"n{i}"].to_numpy() for i in range(len(langs))]) if langs else np.zeros((0, 0))
    return Model(langs, found["k"].to_numpy(), found["gram"].to_pylist(), table)


class Model:
    """Log frequencies per language of words (order 0) and n-grams; one added to every count."""

    def __init__(self, langs: list[str], orders: np.ndarray, names: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        self.rows: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        for k in (WORD, *ORDERS):
            at = np.flatnonzero(np.asarray(orders) == k)
            own = counts[at]
            self.rows[k] = {names[i]: row for row, i in enumerate(at.tolist())}
            self.logs[k] = (np.log(own + 1.0) - np.log(own.sum(axis=0) + len(own) + 1.0)).astype(np.float32)

    def back_off(self, word: str) -> np.ndarray | None:
        for k in ORDERS:
            rows = self.rows[k]
            found = [rows[g] for g in grams(word, k) if g in rows]
            if found:
                return self.logs[k][found].mean(axis=0)
        return None

    def predict(self, text: str | None, unseen: dict) -> tuple[str, float]:
        """Language and its share of the likelihood, per word; UNKNOWN and 0 without a letter or a learned language."""
        words = Counter(words_of(text))
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known, at, weights, extra = self.rows[WORD], [], [], np.zeros(len(self.langs))
        n_extra = 0
        for word, n in words.items():
            row = known.get(word)
            if row is not None:
                at.append(row)
                weights.append(n)
                continue
            v = unseen.get(word, unseen)
            if v is unseen:
                if len(unseen) >= MEMORY:
                    unseen.clear()
                v = unseen[word] = self.back_off(word)
            if v is not None:
                extra += n * v
                n_extra += n
        if not at and not n_extra:  # letters that no learned language has
            return self.langs[0], 1.0 / len(self.langs)
        total = (np.dot(np.array(weights, np.float64), self.logs[WORD][at]) if at else 0.0) + extra
        total = total / (sum(weights) + n_extra)
        best = int(total.argmax())
        return self.langs[best], 1.0 / sum(math.exp(x - total[best]) for x in total)


def grams(word: str, k: int) -> list[str]:
    """Character n-grams of a word; blanks mark its ends, but for single characters."""
    padded = f" {word} " if k > 1 else word
    return [padded[i:i + k] for i in range(len(padded) - k + 1)]


_PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predict(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred, score> of every text. The model depends on nothing but the bounded sample."""
    shared = spark.sparkContext.broadcast(model.__dict__)

    @F.pandas_udf(_PREDICTION)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        local = Model.__new__(Model)
        local.__dict__ = shared.value
        unseen: dict = {}
        for part in texts:
            yield pd.DataFrame([local.predict(t, unseen) for t in part], columns=["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only rows where ``learns`` holds teach, no label is read for a prediction.

    Null texts and texts without a letter get UNKNOWN and score 0. Columns of
    ``docs`` named lang_pred or score are replaced.
    """
    c = lambda name: F.col(f"`{name}`")
    model = fit(docs.filter(learns).select(c(key).alias("key"), c(text).alias("text"), c(lang).alias("lang")), fit_rows)
    keep = [k for k in docs.columns if k not in ("lang_pred", "score")]
    return docs.select(*[c(k) for k in keep], predict(c(text), model, docs.sparkSession).alias("_p")).select(*[c(k) for k in keep], "_p.*")
