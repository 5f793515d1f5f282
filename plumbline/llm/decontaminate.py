"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, so any part of it may be what a document
holds. Test items are dealt to parts of bounded size, and the seeds of one part
are broadcast. A task finds the seeds in its documents, looking at the word of a
seed that fewest items have, groups the hits of one item by neighbouring
diagonals and aligns the passage around each group with the item, unless it has
too few of the item's words for any alignment to be accepted. Nothing of a
document is shuffled, and a passage that many documents share costs each of them
one alignment.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SEED_WORDS = 3
MIN_ITEM_WORDS = 5
ITEMS_PER_PART = 50_000
SCORE = 0.5
LONG_SPAN = 50
MATCH, MISMATCH, GAP = 2, -1, -1

_BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


@F.pandas_udf(ArrayType(StringType()))
def _words_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([[w.decode("utf-8", "surrogatepass") for w in words_of(t)] for t in texts])


def seeds(items: DataFrame, n: int = SEED_WORDS) -> DataFrame:
    """``items(item, text)`` to item, at (position), gram (array of n words): every n-gram of each item.

    Items of fewer than MIN_ITEM_WORDS words say too little to be found and get
    no seed.
    """
    worded = items.select("item", _words_udf("text").alias("w")).filter(F.size("w") >= MIN_ITEM_WORDS)
    return worded.select("item", F.posexplode(F.transform(
        F.slice("w", 1, F.size("w") - (n - 1)), lambda x, i: F.slice(F.col("w"), i + 1, n)
    )).alias("at", "gram"))


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of ``a`` with ``b``: score and the ends (inclusive) in both."""
    ramp = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end_a, end_b = 0, -1, -1
    for i, x in enumerate(a):
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(fresh + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best:
            best, end_a, end_b = int(row[j]), i, j - 1
    return best, end_a, end_b


def smith_waterman(item: list[bytes], passage: list[bytes]) -> tuple[int, int, int]:
    """Score of the best local alignment and its first and last word in ``passage`` (-1, -1 without a match)."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([codes[w] for w in item])
    b = np.array([codes.get(w, -1) for w in passage])
    score, end_a, end_b = _scores(a, b)
    if not score:
        return 0, -1, -1
    # The same alignment read backwards from its end gives its start.
    _, _, back = _scores(a[end_a::-1], b[end_b::-1])
    return score, end_b - back, end_b


class _Part:
    """Seeds and words of one part of the test items, as tasks use them."""

    def __init__(self, items: dict, seed_rows: list) -> None:
        self.items = items
        self.counts = {item: Counter(w) for item, w in items.items()}
        self.grams: dict[tuple, list] = defaultdict(list)
        use: dict[bytes, int] = defaultdict(int)
        for w in items.values():
            for x in set(w):
                use[x] += 1
        self.anchors: dict[bytes, set] = defaultdict(set)
        for item, at, gram in seed_rows:
            self.grams[gram].append((item, at))
            k = min(range(len(gram)), key=lambda i: (use[gram[i]], i))
            self.anchors[gram[k]].add(k)
        self.grams, self.anchors = dict(self.grams), dict(self.anchors)

    def find(self, text: str | None, limit: float) -> list[tuple]:
        """(item, score, first word, last word) of the best accepted alignment with every item that has one."""
        w = words_of(text)
        anchors, grams, n = self.anchors, self.grams, SEED_WORDS
        hits: dict[object, set] = {}
        for i in [i for i, x in enumerate(w) if x in anchors]:
            for k in anchors[w[i]]:
                if i >= k:
                    for item, at in grams.get(tuple(w[i - k:i - k + n]), ()):
                        hits.setdefault(item, set()).add(i - k - at)
        found = []
        for item, diagonals in hits.items():
            own, counts = self.items[item], self.counts[item]
            least = min(limit * MATCH * len(own), MATCH * LONG_SPAN)
            slack = max(8, len(own) // 2)
            best = None
            for lo, hi in _bands(sorted(diagonals), slack):
                start = max(0, lo - slack)
                passage = w[start:hi + len(own) + slack]
                # An alignment matches no word more often than both sides have it.
                common = Counter(x for x in passage if x in counts)
                if MATCH * sum(min(c, counts[x]) for x, c in common.items()) < least:
                    continue
                score, first, last = smith_waterman(own, passage)
                if score >= least and (best is None or score > best[1]):
                    best = (item, score, start + first, start + last)
            if best:
                found.append((item, min(1.0, best[1] / (MATCH * len(own))), *best[2:]))
        return found


def _bands(diagonals: list[int], slack: int) -> list[tuple[int, int]]:
    bands = [[diagonals[0], diagonals[0]]]
    for d in diagonals[1:]:
        if d - bands[-1][1] <= slack:
            bands[-1][1] = d
        else:
            bands.append([d, d])
    return [tuple(b) for b in bands]


def _search_udf(shared, limit: float, kind: str):
    @F.pandas_udf(kind)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        part, ids = shared.value
        for batch in texts:
            yield pd.Series([
                [{"item_id": ids[i], "score": s, "first_word": a, "last_word": b} for i, s, a, b in part.find(t, limit)] for t in batch
            ])

    return search


def contamination(text: Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text", score: float = SCORE,
                  items_per_part: int = ITEMS_PER_PART) -> Column:
    """array<struct<item_id, score, first_word, last_word>>: the test items found in each text.

    An item is found where its best local alignment reaches ``score`` of a full
    match, or the worth of LONG_SPAN matching words. Null and empty texts, and
    items without an id, find nothing; items that repeat an id count once each
    text. Every part of ``items_per_part`` items is searched in all texts.
    """
    kind = items.schema[item_id].dataType.simpleString()
    known = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("id is not null").distinct()
    known = known.withColumn("item", F.xxhash64("id", "text"))
    parts = -(-known.count() // items_per_part) or 1
    dealt = known.withColumn("part", F.pmod("item", F.lit(parts)))
    context = items.sparkSession.sparkContext
    columns = []
    for p in range(parts):
        mine = dealt.filter(F.col("part") == p)
        rows = mine.select("item", "id", "text").collect()  # items_per_part, give or take the hash
        chosen = [(r.item, r.at, tuple(x.encode("utf-8", "surrogatepass") for x in r.gram)) for r in seeds(mine).collect()]
        shared = context.broadcast((_Part({r.item: words_of(r.text) for r in rows}, chosen), {r.item: r.id for r in rows}))

        columns.append(_search_udf(shared, score, f"array<struct<item_id:{kind},score:double,first_word:int,last_word:int>>")(text))
    return reduce(lambda a, b: F.concat(a, b), columns)
