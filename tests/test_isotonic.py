import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import experiments as E
from plumbline.operators import isotonic as I


def brute(rows):
    """Score to fitted value: the slopes of the greatest convex minorant of the summed points."""
    sums = {}
    for p, y in rows:
        w, t = sums.get(p, (0, 0.0))
        sums[p] = (w + 1, t + y)
    xs = sorted(sums)
    points = [(0.0, 0.0)]
    for x in xs:
        points.append((points[-1][0] + sums[x][0], points[-1][1] + sums[x][1]))
    fitted, i = {}, 0
    while i < len(xs):
        j = min(range(i + 1, len(points)), key=lambda k: ((points[k][1] - points[i][1]) / (points[k][0] - points[i][0]), -k))
        for k in range(i, j):
            fitted[xs[k]] = (points[j][1] - points[i][1]) / (points[j][0] - points[i][0])
        i = j
    return fitted


def line(fitted, p):
    xs = sorted(fitted)
    if p <= xs[0] or p >= xs[-1]:
        return fitted[xs[0] if p <= xs[0] else xs[-1]]
    b = next(x for x in xs if x >= p)
    a = max(x for x in xs if x <= p)
    return fitted[a] if a == b else fitted[a] + (fitted[b] - fitted[a]) * (p - a) / (b - a)


CASES = {
    "noisy": lambda rng, i: (rng.random(), None),
    "rare": lambda rng, i: (rng.random() * 1e-5, None),
    "tied": lambda rng, i: (rng.randrange(12) / 12, None),
    "falling": lambda rng, i: (i / 400, 1.0 - i / 400),
    "rising": lambda rng, i: (i / 400, i / 400),
}


@pytest.mark.parametrize("slice_rows", [7, 50_000])
@pytest.mark.parametrize("case", CASES)
def test_blocks_and_lookup_equal_the_convex_minorant(spark, case, slice_rows):
    rng, rows = random.Random(3), []
    for i in range(400):
        p, y = CASES[case](rng, i)
        rows.append((p, float(rng.random() < min(p * (1e5 if case == "rare" else 1), 1)) if y is None else y))
    df = spark.createDataFrame([*rows, (None, 1.0), (0.5, None)], "p double, y double")
    want = brute(rows)
    blocks = I.isotonic_blocks(df, "y", "p", slice_rows=slice_rows, slices=16)
    for b in blocks.collect():
        assert all(abs(want[x] - b.mean) < 1e-9 for x in want if b.lo <= x <= b.hi)
    top = max(want)
    asked = [(x,) for x in [*list(want)[:60], -1.0, top * 2, None, *[rng.random() * top for _ in range(60)]]]
    for lookup in (3, 100_000):
        got = I.isotonic_apply(spark.createDataFrame(asked, "p double"), blocks, "p", "q", lookup=lookup).collect()
        assert len(got) == len(asked)
        for r in got:
            assert r.q is None if r.p is None else abs(r.q - line(want, r.p)) < 1e-9, (r.p, lookup)


def test_calibration_keeps_narrow_scores_apart(spark):
    rows = [(i, i * 1e-8, int(i % 10 < i // 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, p double, y int")
    out = E.calibrate(df, df, "y", "p", "ISOTONIC").agg(F.count_distinct(F.round("p_calibrated", 3)).alias("n"), F.min("p_calibrated").alias("lo"), F.max("p_calibrated").alias("hi")).first()
    assert out.n >= 5 and out.lo < 0.1 and out.hi > 0.8
    assert I.isotonic_apply(df, I.isotonic_blocks(df.limit(0), "y", "p"), "p", "q").filter("q IS NOT NULL").count() == 0
