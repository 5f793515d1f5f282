import math
import random

import numpy as np
import pandas as pd

from plumbline.operators import robustness as B


def brute(predict, row, names, factors, scales, t):
    """All moves of one row, the smallest distance first, then the first feature."""
    up = predict(pd.DataFrame([row]))[0] >= t
    found = []
    for v in factors:
        for i, f in enumerate(names):
            for sign in (1, -1):
                moved = {**row, f: row[f] + sign * v * scales[i]}
                if (predict(pd.DataFrame([moved]))[0] >= t) != up:
                    found.append((v, i))
    return min(found, default=(None, None))


def test_search_asks_only_for_rows_still_open():
    rng, asked = random.Random(5), []
    names, factors, scales = ["a", "b", "c"], [0.1, 0.5, 1.0, 3.0], [1.0, 2.0, 0.5]

    def predict(rows):
        asked.append(len(rows))
        p = 1 / (1 + np.exp(-(rows["a"] + np.sin(3 * rows["b"]).fillna(0.0) - rows["c"].fillna(0.0))))
        return np.column_stack([1 - p, p])

    rows = [{"a": rng.gauss(0, 2), "b": rng.gauss(0, 1) if i % 5 else math.nan, "c": rng.gauss(0, 1)} for i in range(60)]
    which, distance = B.search_batch(predict, pd.DataFrame(rows), factors, scales, 0.5)
    # Both signs of a step are asked for the rows that no earlier step has flipped.
    place = [(factors.index(v), i) if i >= 0 else (len(factors), 0) for i, v in zip(which, distance)]
    steps = [(a, i) for a in range(len(factors)) for i in range(len(names))]
    assert asked == [60] + [2 * n for n in (sum(p >= s for p in place) for s in steps) if n]
    single = lambda frame: predict(frame)[:, 1]
    for row, i, v in zip(rows, which, distance):
        want = brute(single, row, names, factors, scales, 0.5)
        assert (None, None) == want if i < 0 else (v, i) == want


def test_rows_keep_their_keys_and_odd_rows_stay(spark):
    df = spark.createDataFrame([(1, "x", 0.4), (1, "x", 0.4), (2, "y", None), (3, "z", 50.0)], "id long, k0 string, x0 double")
    model = lambda rows: (rows["x0"].to_numpy() > 0.5).astype(float)
    out = B.boundary_distances(df, model, ["x0"], ["k0", "id"], factors=[1.0, 0.1], scales={"x0": 1.0})
    got = sorted((r.id, r.k0, r.feature, r.distance) for r in out.collect())
    assert got == [(1, "x", "x0", 1.0), (1, "x", "x0", 1.0), (2, "y", None, None), (3, "z", None, None)]
    assert B.boundary_distances(df.limit(0), model, ["x0"], ["id"], scales={"x0": 1.0}).count() == 0
