import random

from pyspark.sql import functions as F

from plumbline.operators import sketches as K


def test_merged_partitions_are_within_bounds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 4, float(rng.gauss(0, 1)) if i % 10 else None, rng.choice("aaaab") if i % 3 else f"v{i}", i % 2500) for i in range(12_000)]
    df = spark.createDataFrame(rows, "day int, x double, label string, code int")
    for day in range(4):
        K.profile_sketches(df.filter(F.col("day") == day), ["x", "label", "code"], F.col("day")).write.mode("append").parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    assert stored.count() == 12
    got = {r.feature: r for r in K.profile_estimates(K.merge_profiles(stored)).collect()}
    whole = {r.feature: r for r in K.profile_estimates(K.profile_sketches(df, ["x", "label", "code"])).collect()}
    xs = sorted(r[1] for r in rows if r[1] is not None)
    exact = {"x": len(set(xs)), "label": len({r[2] for r in rows}), "code": 2500}
    for f, r in got.items():
        assert (r.n, r.missing, r.lo, r.hi) == (whole[f].n, whole[f].missing, whole[f].lo, whole[f].hi)
        assert abs(r.distinct_estimate - exact[f]) < 0.06 * exact[f] and abs(whole[f].distinct_estimate - exact[f]) < 0.06 * exact[f]
    assert got["x"].missing == 1200 and got["x"].lo == xs[0] and got["x"].hi == xs[-1]
    for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
        for r in (got["x"], whole["x"]):
            rank = sum(v <= r[name] for v in xs) / len(xs)
            assert abs(rank - q) < 0.02
    assert [x.item for x in got["label"].frequent[:2]] == ["a", "b"] and abs(got["label"].frequent[0]["count"] - sum(r[2] == "a" for r in rows)) < 200
    assert got["label"].median is None and 0 < got["x"].outlier_rate < 0.03


def test_days_can_be_merged_by_part_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, float("nan"))], "day int, x double")
    parts = K.profile_sketches(df, ["x"], F.col("day"))
    got = {r.part: (r.n, r.missing) for r in K.merge_profiles(parts, ["part", "feature"]).collect()}
    assert got == {"1": (2, 1), "2": (1, 1)}
    assert K.profile_estimates(K.merge_profiles(K.profile_sketches(df.limit(0), ["x"]))).count() == 0
