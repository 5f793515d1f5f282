import random
from collections import Counter
from math import comb

import pytest

from plumbline.llm import sharding


def test_hypergeometric_law():
    rng, n = random.Random(1), 20000
    for good, bad, draws in [(5, 7, 4), (1, 9, 3), (30, 2, 20)]:
        seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    assert abs(sharding.hypergeometric(rng, 10**10, 10**10, 10**6) - 500_000) < 5000


def test_matrix_margins():
    rows, shards = [5, 0, 17, 8], sharding.shard_sizes(30, 7)
    m = sharding.communication_matrix(random.Random(3), rows, shards)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m)] == shards


@pytest.mark.parametrize("per_partition", [250_000, 7])
def test_shards_are_exact_and_gapless(spark, per_partition):
    df = spark.createDataFrame([(i % 40 if i % 3 else None, "x") for i in range(500)], "doc_id long, slot string")
    got = sharding.uniform_shards(df, 24, rows_per_partition=per_partition).collect()
    assert Counter(r.doc_id for r in got) == Counter(i % 40 if i % 3 else None for i in range(500))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_every_row_may_reach_every_place(spark):
    df = spark.range(60).withColumnRenamed("id", "doc_id")
    shards = Counter()
    for seed in range(12):
        shards.update(r.shard for r in sharding.uniform_shards(df, 3, seed=seed, partitions=4).collect() if r.doc_id == 7)
    assert len(shards) == 3


def test_empty(spark):
    assert sharding.uniform_shards(spark.createDataFrame([], "doc_id long"), 24).count() == 0
