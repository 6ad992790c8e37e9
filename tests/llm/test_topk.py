import random

import __spark_entry__ as entry
from groundphrase.llm import topk
from oracle import same

SF = "/root/testdata/sf0.01"


def test_oracle(spark):
    same(entry.queries()["op10_topk"](spark, SF), entry.oracle_sql()["op10_topk"], SF)


def test_brute_force_with_many_blocks_and_ties(spark):
    random.seed(4)
    rows = [(i, [random.choice([-1.0, 0.25, 0.5, 3e4]) for _ in range(6)], 1) for i in range(300)] + [(7, [0.5] * 6, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int"), "vec_id % 20 = 0", 5, block=40, query_block=4)
    import math

    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    want = []
    for i, q in ints:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), n) for n, v in ints if n != i)[:5]
            want += [(i, r + 1, n, -s) for r, (s, n) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (None, [1.0]), (5, []), (6, [1e6, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0", 5).collect()))
    assert [(q, n) for q, _, n, _ in got] == [(0, 6), (0, 50), (0, 5), (50, 6), (50, 0), (50, 5)]
    assert got[0][3] == 256 * 256_000_000 + 512 * 256_000_000_000
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert topk.top_k(df.filter("vec_id = 0"), "vec_id % 50 = 0").count() == 0


def test_blocks_of_other_clusters_are_dropped(spark, monkeypatch):
    """On vectors in clusters few pairs of blocks meet; the result is that of brute force."""
    random.seed(8)
    centres = [[random.choice([-8.0, 8.0]) for _ in range(12)] for _ in range(9)]
    rows = [(i, [x + random.random() / 4 for x in centres[i % 9]]) for i in range(1800)]
    met, near = [], topk.near_blocks

    def seen(c, q, n, longest):
        out = near(c, q, n, longest)
        met.append((out.count(), c.count() * n))
        return out

    monkeypatch.setattr(topk, "near_blocks", seen)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", 3, block=100)
    import math

    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for i in range(0, 1800, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[i], v)), n) for n, v in ints.items() if n != i)[:3]
        want += [(i, r + 1, n, -s) for r, (s, n) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert met[0][0] * 3 < met[0][1]
