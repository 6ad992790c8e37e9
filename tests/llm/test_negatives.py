import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from groundphrase.llm import negatives
from oracle import same

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, k=5, low=80, high=100):
    """From the definition; rows are (id, vector, label)."""
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (dim - len(v)), str(n)) for i, v, n in rows
             if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, n in whole:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (n, v)), (n, v))
    limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for a, (n, q) in anchors.items():
        scored = [(-limit(sum(x * y for x, y in zip(q, v))), i, m) for i, v, m in whole if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == n)[:k]:
            fit = sorted(x for x in scored if x[2] != n and low * -s <= 100 * -x[0] <= high * -s)[:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


def test_oracle(spark):
    same(entry.queries()["op13_negatives"](spark, SF), entry.oracle_sql()["op13_negatives"], SF)


@pytest.mark.parametrize("seed, block, anchors", [(1, 40, 7), (2, 1000, 1000), (3, 25, 1)])
def test_brute_force(spark, seed, block, anchors):
    """Vectors in clusters, ties, a label with most rows, null labels, repeated ids."""
    random.seed(seed)
    centres = [[random.choice([-1.0, 0.5, 1.0]) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        v = [x + random.choice([0, 0, 0.25, -0.125]) for x in random.choice(centres)]
        rows.append((i, v, random.choice([1, 1, 1, 1, 2, 3, None])))
    rows += [(20, centres[0], 2), (20, centres[1], 1), (21, centres[2], 3), (21, centres[2], 3)]
    df = spark.createDataFrame([(*r, 0) for r in rows], KIND + ", part int")
    got = negatives.hard_negatives(df, "vec_id % 10 = 0", block=block, anchors=anchors)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert sorted(map(tuple, got.collect())) == want


def test_other_windows(spark):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)], i % 3) for i in range(200)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, KIND), "vec_id % 20 = 0", 3, 50, 120)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 3, 50, 120)


def test_edges(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0], 1), (1, None, 1), (2, [1.0, None], 2), (3, [float("nan"), 1.0], 2), (None, [1.0], 1),
            (4, [], 1), (5, [1.0, 1.5], 2), (6, [1.0, 2.0], None), (7, [0.75], 2), (8, [1e9, 1e15], 2), (9, [1e12, 1e16], 1), (200, [1e9, 1e14], 2), (10, [1e9, 9e13], 1)]
    df = spark.createDataFrame(rows, KIND)
    got = negatives.hard_negatives(df, "vec_id % 100 = 0")
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0)
    for few in (df.limit(0), df.filter("vec_id = 0"), df.filter("vec_id = 5"), df.filter("vec_id = 4")):
        assert negatives.hard_negatives(few, "vec_id % 100 = 0").count() == 0


def test_tree_is_spanning_and_least():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 3))
    order, parent, edge = negatives.spanning_tree(points)
    seen = {int(order[0])}
    for x in order[1:].tolist():
        assert int(parent[x]) in seen and abs(np.linalg.norm(points[x] - points[parent[x]]) - edge[x]) < 1e-9
        seen.add(x)
    assert len(seen) == 60
    links = sorted((float(np.linalg.norm(points[i] - points[j])), i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0
    for d, i, j in links:  # the other way of making it: shortest links first
        if root[i] != root[j]:
            total += d
            root = [root[i] if r == root[j] else r for r in root]
    assert abs(total - edge.sum()) < 1e-9


def test_few_candidates_are_scored_where_anchors_are_near():
    rng = np.random.default_rng(4)
    v = rng.integers(-200, 200, size=(4000, 16))
    a = v[:1] + rng.integers(-2, 3, size=(200, 16))
    scores = negatives.Scores(v, a)
    tree = negatives.spanning_tree(a.astype("float64"))
    best = {x: (at, s) for x, at, s in scores.walk(*tree, lambda x, lo, hi: hi >= np.sort(lo)[-5])}
    for x in range(200):
        exact = v @ a[x]
        at, s = best[x]
        assert (exact[at] == s).all() and set(np.argsort(-exact, kind="stable")[:5].tolist()) <= set(at.tolist())
    assert scores.rescored < 0.2 * v.shape[0] * 200
