import itertools
import math
import random

import pytest

from plumbline.operators import scoring as S
from plumbline.operators import trees as R

NODES = "tree int, node int, feature string, threshold double, left int, right int, missing_left boolean, value double, cover double"
FEATURES = ["a", "b", "c", "d", "unused"]


def grown(rng, tree, depth):
    """A random tree as node rows; covers of children add up."""
    rows = []

    def grow(node, cover, depth):
        if depth == 0 or rng.random() < 0.15 or cover < 3:
            rows.append((tree, node, None, None, None, None, None, rng.uniform(-1, 1), cover))
            return
        left = rng.randrange(1, int(cover))
        first, second = next(ids), next(ids)
        rows.append((tree, node, rng.choice("abcd"), rng.choice([0.0, 0.25, 0.5, 0.75]), first, second, rng.choice([True, False, None]), None, cover))
        grow(first, float(left), depth - 1)
        grow(second, cover - left, depth - 1)

    ids = itertools.count(1)
    grow(0, 200.0, depth)
    return rows


def expected(nodes, row, known, strict):
    """The tree's value where the features of ``known`` are fixed to the row and the others follow the covers."""

    def down(i):
        n = nodes[i]
        if n[2] is None:
            return n[7]
        ways = (n[4], n[5])
        if n[2] in known:
            x = row[n[2]]
            left = (n[6] is not False) if x is None or math.isnan(x) else (x < n[3] if strict else x <= n[3])
            return down(ways[0] if left else ways[1])
        return sum(nodes[w][8] * down(w) for w in ways) / n[8]

    return down(0)


@pytest.mark.parametrize("strict", [False, True])
def test_attributions_equal_all_subsets(spark, strict):
    rng = random.Random(7 + strict)
    rows = [r for t in range(4) for r in grown(rng, t, 5)] + [(9, 0, None, None, None, None, None, 0.5, 10.0)]
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r[0], {})[r[1]] = r
    data = [(i, *[rng.choice([0.0, 0.25, 0.3, 0.6, 0.75, 1.0, None, float("nan")]) for _ in FEATURES]) for i in range(40)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    model = R.tree_ensemble(spark.createDataFrame(rows, NODES), offset=0.25, scale=0.5, strict=strict, part=40)
    assert len(model.parts(FEATURES)) > 1
    scores = {r.id: r.p for r in S.score(df, model, FEATURES).collect()}
    got = {}
    for r in S.attribute(df, model, FEATURES, ["id"]).collect():
        got.setdefault(r.id, {})[r.feature] = r.value
    base = model.base()
    for i, *xs in data:
        row = dict(zip(FEATURES, xs))
        value = lambda known: 0.25 + 0.5 * sum(expected(t, row, known, strict) for t in by_tree.values())
        assert abs(scores[i] - value(set(FEATURES))) < 1e-9 and abs(base - value(set())) < 1e-9
        assert abs(sum(got[i].values()) + base - scores[i]) < 1e-9
        for f in FEATURES:
            others, m, phi = [g for g in FEATURES if g != f], len(FEATURES), 0.0
            for k in range(m):
                for s in itertools.combinations(others, k):
                    weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    phi += weight * (value({*s, f}) - value(set(s)))
            assert abs(got[i][f] - phi) < 1e-9, (i, f)


def test_covers_are_counted_and_logistic_output(spark):
    rows = [(0, 0, "a", 0.5, 1, 2, True, None), (0, 1, "b", 0.5, 3, 4, True, None), (0, 2, None, None, None, None, None, 1.0),
            (0, 3, None, None, None, None, None, 2.0), (0, 4, None, None, None, None, None, 3.0)]
    nodes = spark.createDataFrame([(*r, 0.0) for r in rows], NODES)
    df = spark.createDataFrame([(0.1, 0.1), (0.1, 0.1), (0.9, None), (None, 0.2)], "a double, b double")
    counted = {r.node: r.cover for r in R.with_covers(nodes, df, ["a", "b"]).collect()}
    assert counted == {0: 4.0, 1: 3.0, 2: 1.0, 3: 3.0, 4: 1.0}
    model = R.tree_ensemble(R.with_covers(nodes, df, ["a", "b"]), logistic=True)
    assert [round(r.p, 6) for r in S.score(df, model, ["a", "b"]).collect()] == [round(1 / (1 + math.exp(-v)), 6) for v in (2, 2, 1, 2)]
    assert S.attribute(df.limit(0), model, ["a", "b"], ["a"]).count() == 0
