"""SimHash near-duplicates: blocks by the pigeonhole principle, then Hamming distance.

A 64-bit fingerprint is cut into ``BLOCKS`` blocks. Two fingerprints that differ
in at most ``DISTANCE`` bits agree on at least ``BLOCKS - DISTANCE`` blocks, so
they meet under one of the C(BLOCKS, DISTANCE) keys made of that many blocks.
Copies collapse to one row before any key is made. Under a key, fingerprints are
dealt to chunks of bounded size and every pair of chunks is compared in one
call; a call returns a spanning forest of the links it finds, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plumbline.functions.components import components
from plumbline.llm.storage import stored

SEED = 42
DISTANCE = 3
BLOCKS = 6
SHINGLE = 3
CHUNK = 1024


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text: bits that more than half of the shingle hashes have; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and the six ASCII blanks
    if not words:
        return 0
    k = SHINGLE
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start:start + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def block_keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """array<struct<which, value>>: the fingerprint under each choice of the blocks that must agree."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("which"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


def forest(values: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Ends of a spanning forest over the pairs of ``values`` (signed) at most ``distance`` bits apart."""
    rest = np.unique(values).view(np.uint64)
    left, right = [], []
    while len(rest):
        queue, rest = [rest[-1]], rest[:-1]
        while queue and len(rest):
            v = queue.pop()
            near = np.bitwise_count(rest ^ v) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                left += [int(v.view(np.int64))] * len(found)
                right += found.view(np.int64).tolist()
                queue.extend(found)
    return left, right


@F.pandas_udf(ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())])))
def _links_udf(members: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([
        [{"a": a, "b": b} for a, b in zip(*forest(np.asarray(m, np.int64), int(d)))] for m, d in zip(members, distance)
    ])


def near_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """``fps(fp)``, distinct, to links (a, b) whose components are those of all pairs within ``distance`` bits."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.which", "k.value")
    size = keyed.groupBy("which", "value").agg(F.count("*").alias("n")).filter("n > 1")
    size = stored(size.withColumn("g", F.ceil(F.col("n") / F.lit(chunk)).cast("int")).drop("n"))
    # Every chunk of a key meets every other one, and itself, in one group of two chunks at most.
    here = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("g")).cast("int")
    dealt = keyed.join(size, ["which", "value"]).withColumn("c", here).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    pairs = dealt.groupBy("which", "value", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")).agg(F.collect_list("fp").alias("fps"))
    found = pairs.select(F.explode(_links_udf("fps", F.lit(distance))).alias("l"))
    return found.select("l.a", "l.b").distinct()


def _grouped(docs: DataFrame, id_col: str, text: str, distance: int, blocks: int, chunk: int) -> DataFrame:
    """id, th (text hash), fp, root (a fingerprint naming the group), component_id for every row."""
    body = F.col(f"`{text}`")
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("th"), fingerprint_udf(body).alias("fp")))
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    groups = stored(components(stored(near_links(distinct.select("fp"), distance, blocks, chunk)), stored))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted)
    named = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return rows.join(stored(rooted.join(named, "root").select("fp", "root", "component_id")), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS,
                   chunk: int = CHUNK) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``, repeated rows included.

    ``component_id`` is the smallest id among the rows whose fingerprints are
    linked, directly or through others, by at most ``distance`` differing bits;
    it is null only where no row of the group has an id. Null texts and texts
    without a word have fingerprint zero and are linked like any other.
    """
    return _grouped(docs, id_col, text, distance, blocks, chunk).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with the columns of ``docs``.

    The row with the smallest id stays; of several with that id the one with the
    smallest text hash, of wholly repeated rows any one. Rows without an id stay
    only where their group has no id.
    """
    rows = stored(_grouped(docs, id_col, text, DISTANCE, BLOCKS, CHUNK))
    first = rows.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("id").alias("_id"), F.min("th").alias("_th")
    )
    keep = stored(first.select("_id", "_th").distinct())
    named = docs.withColumn("_hash", F.xxhash64(F.col(f"`{text}`")))
    left = named.join(keep.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), "_hash").orderBy("_hash"))
    return left.withColumn("_nth", nth).filter("_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
