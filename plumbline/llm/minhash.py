"""MinHash near-duplicates: universal hash minima, bands, signatures, exact sets, star components.

A text's set are its distinct shingles of ``SHINGLE`` words. ``HASHES`` hash
functions of a 2-universal family keep their minima over the set; ``BANDS``
bands of equally many minima are bucket keys. Two texts at the threshold of 0.8
share no band with a probability of (1 - 0.8^4)^32 = 5e-8, and a pair is only
refused by its signature below ``SIGN_AT`` of 128 equal minima, 4.5 standard
deviations under the threshold. Every pair that is linked was confirmed on the
full sets.

No pairs of a bucket are ever made. Texts of equal words are one node. First
every node is held against one node, the least of the bucket it shares with
others most often, and components are formed: that settles groups of near copies
with one comparison a text. Then components that meet in a bucket are held
against each other through its least and its greatest node, one comparison for
two components. What is left are buckets in which several components meet; their members are dealt to chunks, members outside the largest component
meet all chunks, and a call looks at two chunks: it returns the nodes with a
likely partner in another component, and for those, with their texts, a spanning
forest of the confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from plumbline.llm.stars import connected
from plumbline.llm.storage import stored

SHINGLE = 4
PERCENT = 80
HASHES, BANDS = 128, 32
SIGN_AT = 82
CHUNK = 512
SEED = 13

_draw = np.random.Generator(np.random.PCG64(SEED))
_A = _draw.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 2**64, HASHES, dtype=np.uint64)
_MIX = _draw.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes know only the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(found: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes: k consecutive word hashes in one polynomial."""
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w, SEED) for w in found), np.uint64, len(found))
    k = min(k, len(one))
    total = np.zeros(len(one) - k + 1, np.uint64)
    for i in range(k):
        total = total * _MIX[i] + one[i:len(one) - k + 1 + i]
    total ^= total >> np.uint64(31)
    return np.unique(total * _MIX[15])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash (a x + b mod 2^64) over 32 bits of the shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    x = shingles >> np.uint64(32)
    for start in range(0, len(x), 256):
        np.minimum(least, (np.multiply.outer(x[start:start + 256], _A) + _B).min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, HASHES // BANDS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = (key ^ (key >> np.uint64(29))) * _MIX[4 + j] + rows[:, j]
    key ^= key >> np.uint64(32)
    return (key * _MIX[14]).view(np.int64)


_SIGNED = "text_key binary, n_shingles long, signature binary, bands array<long>"


def _signing(k: int):
    @F.pandas_udf(_SIGNED)
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            out = []
            for t in part:
                found = words(t)
                shingles = shingle_set(found, k)
                least = minima(shingles) if len(shingles) else None
                out.append((
                    hashlib.blake2b(b" ".join(found), digest_size=16).digest(), len(shingles),
                    None if least is None else (least & np.uint64(255)).astype(np.uint8).tobytes(), None if least is None else band_keys(least),
                ))
            yield pd.DataFrame(out, columns=["text_key", "n_shingles", "signature", "bands"])

    return sign


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HASHES)


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((_bytes(a) == _bytes(b)).sum(axis=1) >= SIGN_AT) if len(a) else pd.Series([], dtype=bool)


def close(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a n b| >= percent |a u b| for sorted sets; sizes alone refuse most."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = small + large - len(np.union1d(a, b))
    return 100 * both >= percent * (small + large - both)


def _confirming(k: int, percent: int):
    @F.pandas_udf("boolean")
    def confirm(a: pd.Series, b: pd.Series) -> pd.Series:
        kept: dict[str, np.ndarray] = {}

        def sets(t: str) -> np.ndarray:
            if t not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[t] = shingle_set(words(t), k)
            return kept[t]

        return pd.Series([close(sets(x), shingle_set(words(y), k), percent) for x, y in zip(a, b)], dtype=bool)

    return confirm


@F.pandas_udf(ArrayType(LongType()))
def _meeting(nodes: pd.Series, roots: pd.Series, signatures: pd.Series) -> pd.Series:
    """Of the members of two chunks, those with a likely partner in another component, in order."""
    out = []
    for n, r, s in zip(nodes, roots, signatures):
        n, first = np.unique(np.asarray(n, np.int64), return_index=True)
        r, s = np.asarray(r, np.int64)[first], _bytes([s[i] for i in first])
        hit = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            near = ((s[i + 1:] == s[i]).sum(axis=1) >= SIGN_AT) & (r[i + 1:] != r[i])
            if near.any():
                hit[i] = True
                hit[i + 1:] |= near
        out.append(n[hit].tolist())
    return pd.Series(out)


def spanning(roots: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places of confirmed links that join the components among the members of a group; none between members joined already."""
    links, joined = [], roots.copy()
    _, shingles = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    offset = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(shingles) and int(shingles.max()) + 1, np.int64)
    for i in range(len(roots) - 1):
        near = ((signatures[i + 1:] == signatures[i]).sum(axis=1) >= SIGN_AT) & (joined[i + 1:] != joined[i])
        if not near.any():
            continue
        own = shingles[offset[i]:offset[i + 1]]
        mark[own] = 1
        first, last = i + 1 + int(near.argmax()), len(roots) - int(near[::-1].argmax())
        both = np.add.reduceat(mark[shingles[offset[first]:offset[last]]], offset[first:last] - offset[first])
        mark[own] = 0
        close_by = near[first - i - 1:last - i - 1] & (100 * both >= percent * (size[i] + size[first:last] - both))
        for j in np.flatnonzero(close_by) + first:
            if joined[i] != joined[j]:
                links.append((i, int(j)))
                joined[joined == joined[j]] = joined[i]
    return links


def _forest(k: int, percent: int):
    @F.pandas_udf("array<struct<a: long, b: long>>")
    def forest(nodes: pd.Series, roots: pd.Series, signatures: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for n, r, s, t in zip(nodes, roots, signatures, texts):
            found = spanning(np.asarray(r, np.int64), _bytes(s), [shingle_set(words(x), k) for x in t], percent)
            out.append([{"a": int(n[i]), "b": int(n[j])} for i, j in found])
        return pd.Series(out)

    return forest


def _texts_of(nodes: DataFrame, wanted: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``node``, ``text`` of the wanted nodes, from the row that stands for each."""
    rows = nodes.join(wanted, "node", "left_semi").select("node", F.col("least.id").alias("i"), F.col("least.th").alias("h"))
    body = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))
    return body.join(rows.hint("merge"), same).groupBy("node").agg(F.any_value("text").alias("text"))


def _mixed(shared: DataFrame, chunk: int) -> DataFrame:
    """Buckets in which several components meet, as groups of two chunks: ``b``, ``i``, ``j``, ``node``, ``root``.

    The members of a bucket's largest component never meet each other: the other
    members are dealt to chunks i, all members to chunks j, and each chunk i meets
    each chunk j.
    """
    parts = shared.groupBy("b", "root").agg(F.count("*").alias("n"))
    whole = parts.groupBy("b").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
    whole = stored(whole.filter("parts > 1").select(
        "b", F.col("top.root").alias("top"), F.ceil(F.col("n") / chunk).cast("int").alias("all"),
        F.ceil((F.col("n") - F.col("top.n")) / chunk).cast("int").alias("minor"),
    ))
    dealt = shared.join(whole, "b").withColumn("h", F.xxhash64("node", F.lit(1)))
    j, i = F.pmod("h", "all").cast("int"), F.pmod("h", "minor").cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_all = F.transform(upto("minor"), lambda x: F.struct(x.alias("i"), j.alias("j")))
    as_minor = F.when(F.col("root") != F.col("top"), F.transform(upto("all"), lambda x: F.struct(i.alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    places = F.array_distinct(F.concat(as_all, as_minor))
    return dealt.select("b", "node", "root", F.explode(places).alias("p")).select("b", "p.i", "p.j", "node", "root")


def _joined(nodes: DataFrame, known: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node: the components known, joined by further links between their members."""
    if known is None:
        known = nodes.select("node", F.col("node").alias("root"))
    at = lambda side: known.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    over = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    grown = connected(over).select(F.col("node").alias("mid"), F.col("root").alias("to"))
    return known.withColumnRenamed("root", "mid").join(grown, "mid", "left").select("node", F.coalesce("to", "mid").alias("root"))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                   chunk: int = CHUNK) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``, repeated rows included.

    Rows are linked where ``100 * |intersection| >= percent * |union|`` of their
    shingle sets; ``component_id`` is the smallest id reachable, ``kept`` whether
    it is the row's own. A text with fewer words than ``shingle`` has its whole
    sequence as only shingle. Null texts and texts without a word have an empty
    set and are linked with nothing, not even with each other. Rows without an
    id have no ``component_id`` of their own and are not kept, but link others;
    wholly repeated rows share a component. Texts are taken whole at any length;
    an empty table gives an empty result. Other columns, whatever their names,
    are not read.
    """
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("th"), _signing(shingle)(body).alias("s"))
    rows = stored(rows.select("id", "th", "s.*"))
    nodes = rows.filter("n_shingles > 0").groupBy("text_key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    keyed = nodes.select("node", F.explode("bands").alias("b"))
    buckets = keyed.groupBy("b").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("n"))
    shared = stored(keyed.join(stored(buckets.filter("n > 1").drop("n")), "b"))

    signs = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"{name}_s"))
    likely = lambda pairs: pairs.join(signs("node"), "node").join(signs("hub"), "hub").filter(_likely("node_s", "hub_s")).drop("node_s", "hub_s")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
        texts = stored(_texts_of(nodes, ends, docs, id_col, text))
        both = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
        return stored(both.filter(_confirming(shingle, percent)("hub_text", "text")).select(F.col("node").alias("a"), F.col("hub").alias("b")))

    often = shared.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    pairs = often.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("m")).select("node", F.col("m.hub").alias("hub"))
    first = stored(_joined(nodes, None, confirmed(stored(likely(pairs)))))

    root_of = lambda name: first.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    both = shared.select("node", "hub").unionByName(shared.select("node", F.col("top").alias("hub")))
    apart = both.join(root_of("node"), "node").join(root_of("hub"), "hub").filter("node_root <> hub_root")
    ways = likely(apart.distinct()).groupBy(F.least("node_root", "hub_root"), F.greatest("node_root", "hub_root")).agg(F.min(F.struct("node", "hub")).alias("w"))
    first = stored(_joined(nodes, first, confirmed(stored(ways.select("w.node", "w.hub")))))

    rooted = shared.select("b", "node").join(first, "node")
    places = _mixed(stored(rooted), chunk).join(signs("node"), "node")
    groups = places.groupBy("b", "i", "j").agg(F.collect_list(F.struct("node", "root", F.col("node_s").alias("s"))).alias("m"))
    met = groups.select(_meeting("m.node", "m.root", "m.s").alias("met")).filter(F.size("met") > 1).distinct()
    met = stored(met.withColumn("g", F.monotonically_increasing_id()))
    members = stored(met.select("g", F.explode("met").alias("node")))
    texts = stored(_texts_of(nodes, members.select("node").distinct(), docs, id_col, text))
    given = members.join(first, "node").join(signs("node"), "node").join(texts, "node")
    gathered = given.groupBy("g").agg(F.collect_list(F.struct("node", "root", F.col("node_s").alias("s"), "text")).alias("m"))
    links = gathered.select(F.explode(_forest(shingle, percent)("m.node", "m.root", "m.s", "m.text")).alias("l")).select("l.a", "l.b")

    named = stored(_joined(nodes, first, stored(links)))
    owned = nodes.select("node", "text_key", F.col("least.id").alias("id")).join(named, "node")
    smallest = stored(owned.groupBy("root").agg(F.min("id").alias("component_id")))
    classes = stored(owned.select("text_key", "root").join(smallest, "root").select("text_key", "component_id"))
    out = rows.select("id", "n_shingles", "text_key").join(classes, "text_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
