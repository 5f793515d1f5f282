"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents in hash order. In each window a source is
given a quantum of ``WINDOW`` tokens times its share; a document leaves its
queue in the first window in which the credit given so far covers it, so what a
window leaves unused is carried to the next ones. With prefix sums this is a
closed form: a document whose tokens end at ``e`` of its queue leaves in window
``ceil(e / quantum)``. The windows one after the other, sources in order inside
a window, make one stream, and the stream is cut every ``LENGTH`` tokens; only
the last sequence is padded.

Prefix sums run in two levels (sums of buckets, then rows inside a bucket), so
neither a large source nor the whole stream passes through one task.
"""

from __future__ import annotations

import json
import re
import zlib
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from plumbline.llm.storage import stored

LENGTH = 1024
WINDOW = 64 * LENGTH
QUEUE_BUCKETS = 4096
WINDOWS_PER_BLOCK = 4096
END = 0


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Strings, with their ids, that a tokenizers file takes out of a text before it is split into words."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that match as they are")
    return tuple((t["content"], t["id"]) for t in found)


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, added: tuple[tuple[str, int], ...] = ()):
    """Encoder of a byte-level BPE vocabulary file: ranks through tiktoken, a tokenizers file as it is.

    Both give the same ids for one vocabulary; the ranks are about six times as
    fast. ``added`` strings become their ids wherever they stand, the longest
    first; without them they are ordinary text.
    """
    if vocabulary.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if not added:
            return lambda texts: [coder.encode_ordinary(t) for t in texts]
        known = dict(added)
        cuts = re.compile("(" + "|".join(re.escape(a) for a in sorted(known, key=len, reverse=True)) + ")")

        def ids(text: str) -> list[int]:
            parts = cuts.split(text)
            if len(parts) == 1:
                return coder.encode_ordinary(text)
            # Odd parts are the added strings; words never reach across them.
            return [i for n, part in enumerate(parts) for i in ([known[part]] if n % 2 else coder.encode_ordinary(part))]

        return lambda texts: [ids(t) for t in texts]
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary)
    coder.encode_special_tokens = not added
    return lambda texts: [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]


def encode(texts: list[str | None], vocabulary: str, added: tuple[tuple[str, int], ...] = ()) -> list[np.ndarray]:
    """Token ids of every text, then END."""
    return [np.array([*ids, END], "<u4") for ids in _encoder(vocabulary, added)([t or "" for t in texts])]


def _ids_udf(vocabulary: str, added: tuple[tuple[str, int], ...]):
    @F.pandas_udf(BinaryType())
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for start in range(0, len(part), 64):
                out += [_pack(x) for x in encode(list(part[start:start + 64]), vocabulary, added)]
            yield pd.Series(out, dtype=object)

    return ids


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, behind a byte that tells the width."""
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\4" + ids.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def _before(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group that come before, buckets first, then ``order``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_s"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    starts = sums.withColumn("_start", F.sum("_s").over(over.orderBy(bucket)) - F.col("_s")).drop("_s")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    return df.withColumn("_in", F.sum(value).over(inside) - F.col(value)).join(stored(starts), [*group, bucket]).withColumn(
        name, F.col("_start") + F.col("_in")
    ).drop("_start", "_in")


def schedule(docs: DataFrame, window: int = WINDOW, shares: dict[str | None, float] | None = None) -> DataFrame:
    """``docs(rid, source_key, tokens)`` with ``start``, the place of the first token in the packed stream.

    ``shares`` are the target proportions of the sources (by default their shares
    of all tokens, which makes every window alike and all queues end together).
    Sources without a share above zero follow after all others.
    """
    totals = docs.groupBy("source_key").agg(F.sum("tokens").alias("t"))
    if shares is None:
        everything = docs.agg(F.sum("tokens").alias("all"))
        quanta = totals.join(everything).select("source_key", F.greatest(F.col("t") * F.lit(float(window)) / F.col("all"), F.lit(1e-9)).alias("quantum"))
    else:
        known = {"" if k is None else "=" + k: v for k, v in shares.items() if v > 0}
        whole = sum(known.values()) or 1.0
        table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, window * v / whole)]) if known else F.create_map().cast("map<string,double>")
        quanta = totals.select("source_key", table[F.col("source_key")].alias("quantum"))
    queued = docs.withColumn("h", F.xxhash64("rid", F.lit(7)))
    queued = queued.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * QUEUE_BUCKETS).cast("int"))
    queued = _before(queued, ["source_key"], "bucket", ["h", "rid"], "tokens", "queue_start")
    end = (F.col("queue_start") + F.col("tokens")).cast("double")
    later = F.lit(2**40) + F.ceil(end / F.lit(float(window)))
    timed = queued.join(stored(quanta), "source_key").select(
        "rid", "source_key", "tokens", "queue_start", F.coalesce(F.ceil(end / F.col("quantum")), later).alias("window")
    )
    timed = stored(timed.withColumn("block", F.floor(F.col("window") / WINDOWS_PER_BLOCK)))
    windows = timed.groupBy("block", "window").agg(F.sum("tokens").alias("tokens"))
    placed = stored(_before(windows, [], "block", ["window"], "tokens", "window_start").select("window", "window_start"))
    inside = Window.partitionBy("window").orderBy("source_key", "queue_start", "rid")
    here = timed.withColumn("_in", F.sum("tokens").over(inside) - F.col("tokens"))
    return here.join(placed, "window").select("rid", (F.col("window_start") + F.col("_in")).alias("place"), "window")


_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cut(ids: np.ndarray, place: int, length: int) -> Iterator[tuple[int, ...]]:
    """Pieces of a document whose first token is at ``place`` of the stream, in the order of _PIECE."""
    start = 0
    while start < len(ids):
        sequence, offset = divmod(place + start, length)
        n = min(length - offset, len(ids) - start)
        yield start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), sequence, offset
        start += n


def _cut_udf(length: int, with_ids: bool):
    fields = [StructField(n, LongType()) for n in _PIECE] + [StructField("ids", BinaryType())] * with_ids

    @F.pandas_udf(ArrayType(StructType(fields)))
    def pieces(data: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for d, place in zip(data, places):
            ids = _unpack(d)
            found = [dict(zip(_PIECE, p)) for p in cut(ids, int(place), length)]
            if with_ids:
                for f in found:
                    f["ids"] = ids[f["start"]:f["start"] + f["length"]].tobytes()
            out.append(found)
        return pd.Series(out)

    return pieces


def pack(docs: DataFrame, vocabulary: str, text: str = "text", source: str = "source", length: int = LENGTH, window: int = WINDOW,
         shares: dict[str | None, float] | None = None, with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: the columns of ``docs`` but for the text, then start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is tokenized once, an END after it; each id lies in
    exactly one piece. Null and empty texts are a single END; rows without a
    source form a queue of their own; repeated rows are packed one by one. With
    ``with_ids`` a binary column ``ids`` (little-endian 32 bit) holds the tokens.
    ``added`` are strings with ids of their own (``added_tokens`` reads them from
    a tokenizers file); where none are given, such strings are ordinary text.
    """
    names = [*_PIECE, "ids"]
    keep = [c for c in docs.columns if c != text and c not in names]
    c = lambda name: F.col(f"`{name}`")
    key = F.when(c(source).isNull(), "").otherwise(F.concat(F.lit("="), c(source).cast("string")))
    tokens = stored(docs.select(
        F.monotonically_increasing_id().alias("_rid"), key.alias("_key"), F.struct(*[c(k) for k in keep]).alias("_row"),
        _ids_udf(vocabulary, added)(c(text)).alias("_ids"),
    ))
    width = F.when(F.substring("_ids", 1, 1) == F.lit(b"\2"), 2).otherwise(4)
    sizes = tokens.select(F.col("_rid").alias("rid"), F.col("_key").alias("source_key"), ((F.octet_length("_ids") - 1) / width).cast("long").alias("tokens"))
    places = stored(schedule(sizes, window, shares))
    # Sorted merge at every size: the same plan for small and large tables.
    joined = tokens.join(places.hint("merge"), tokens["_rid"] == places["rid"])
    pieces = joined.select("_row", F.explode(_cut_udf(length, with_ids)("_ids", "place")).alias("_piece"))
    return pieces.select(*[F.col("_row")[k].alias(k) for k in keep], "_piece.*")
