"""Connected components against union-find, in one chunk and in many, with broadcast and with shuffled minima."""

import random

import pytest
from groundphrase.operators import graph as g


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize(("chunk", "broadcast"), [(1 << 20, 200_000), (40, 200_000), (40, 0)])
def test_components(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(g, "CHUNK", chunk)
    monkeypatch.setattr(g, "BROADCAST", broadcast)
    random.seed(chunk)
    path = random.sample(range(1000, 1100), 100)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(120)] + list(zip(path, path[1:], strict=False))
    edges += [(2000, 2000 + i) for i in range(300)] + [(4000, 3000 + i) for i in range(200)] + [(None, 3), (4, None), (5, 5), (2, 1), (2, 1)]
    random.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(6)
    got = [(r.node, r.component) for r in g.components(df, "x", "y").collect()]
    assert len(got) == len(set(got)) and dict(got) == brute(edges)
    assert g.components(df.limit(0), "x", "y").count() == 0
