import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import minhash
from plumbline.llm.queries import QUERIES
from plumbline.llm.stars import connected
from tests.llm.test_dedup import closure


def brute(rows, k=4, percent=80):
    """doc_id, n_shingles, component_id by all pairs of sets of strings."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = closure(pairs, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted((d, len(sets[i]), least.get(root[i]) if sets[i] else d) for i, (d, _) in enumerate(rows) if d is not None)


def made(rng, n=40, copies=5):
    vocabulary = [f"W{i}é" for i in range(400)]
    rows = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 80, 300]))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


def test_groups_equal_all_pairs_with_small_chunks(spark):
    rng = random.Random(4)
    rows = made(rng) + [(5001, None), (5002, ""), (5003, " \n"), (5004, "One two"), (5005, "one  TWO"), (5006, "one"), (None, "one"), (5004, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("node", "root", "b", "s", "th", "id", "_id", "component_id")])
    out = minhash.minhash_groups(clash, chunk=3)
    assert got(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id and r.doc_id is not None) for r in out.collect())


def test_components_meet_in_chunks(spark):
    """Chains whose ends are far apart, and a crowd at 0.7 around them that must stay apart."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(25):
        w = list(base)
        for i in range(6 * (g % 12)):
            w[(i * 5 + g) % 120] = f"x{g}_{i}"
        rows.append((g + 1, " ".join(w)))
        w[g] = "edited"
        rows.append((g + 501, " ".join(w)))
    rows.append((900, " ".join(f"long{rng.randrange(10**6)}" for _ in range(60_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.minhash_groups(df, chunk=2)) == brute(rows)


def test_query_equals_all_pairs_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_minhash_near_dedup"](spark, folder)) == brute(rows)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    share = (minhash.minima(np.unique(a)) == minhash.minima(np.unique(b))).mean()
    assert abs(share - 0.8) < 0.12


def test_empty_table_and_stars(spark):
    assert minhash.minhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    pairs += [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = closure([p for p in pairs if p[0] != p[1]], {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.node: r.root for r in connected(links).collect()} == want
    assert connected(links.limit(0)).count() == 0
