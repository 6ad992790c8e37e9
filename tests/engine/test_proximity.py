"""Joins on cells against joins of all pairs, and groups of a dense patch."""

import random
import time

import pytest
from groundphrase.functions import geometry as g
from groundphrase.operators import relations as r
from groundphrase.operators.graph import components_within
from groundphrase.operators.proximity import cell_join
from pyspark.sql import functions as F

KIND = "patch_id long, object_id long, category string, pos int, xmin int, ymin int, xmax int, ymax int, is_cutoff boolean"


def objects(spark, seed, n, patches, span, sizes=(4, 9, 30, 30, 700)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randint(-span, span), rng.randint(0, span)
        w, h = rng.choice(sizes), rng.choice(sizes)
        rows.append((i % patches, i, rng.choice("ab"), i, x, y, x + w, y + h, rng.random() < 0.1))
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("seed, span", [(1, 600), (2, 4000), (3, 40)])
def test_cells_give_what_all_pairs_give(spark, seed, span):
    o = g.with_geometry(objects(spark, seed, 300, 3, span))
    ids = lambda d: sorted((x.a_object_id, x.b_object_id) for x in d.select("a_object_id", "b_object_id").collect())
    slim = o.select("patch_id", "object_id", *r._BOX)
    want = ids(r.self_pairs(slim, ["patch_id"], r.near_enough(50.0)))
    assert ids(cell_join(slim, slim, ["patch_id"], r._reach(50.0), 20.0, r.near_enough(50.0))) == want and len(want) > 20
    odd, even = slim.filter("object_id % 2 = 1"), slim.filter("object_id % 2 = 0")
    got = ids(cell_join(odd, even, ["patch_id"], r._reach(50.0), 100.0, r.near_enough(50.0)))
    assert got == [x for x in want if x[0] % 2 == 1 and x[1] % 2 == 0]
    gap = g.box_gap("a_", "b_")
    near = r.self_pairs(o.filter("not is_cutoff"), ["patch_id", "category"], (F.col("a_object_id") < F.col("b_object_id")) & (gap <= 40))
    assert sorted((x.a, x.b) for x in r.near_pairs(o).collect()) == ids(near)


def test_no_rows_and_rows_without_a_place(spark):
    o = objects(spark, 1, 10, 1, 50)
    assert r.relate(o.limit(0)).count() == 0 and r.group_rows(o.limit(0), r.clusters(o.limit(0))).count() == 0
    lost = o.withColumn("xmin", F.when(F.col("object_id") > 1, F.col("xmin")))
    assert r.near_pairs(lost).filter("a < 2 or b < 2").count() == 0


def test_a_patch_of_100000_objects(spark):
    o = spark.range(100_000).selectExpr(
        "7L AS patch_id", "id AS object_id", "CASE WHEN id % 3 = 0 THEN 'ship' ELSE 'plane' END AS category", "CAST(id AS int) AS pos",
        "CAST(id * 7919 % 30011 AS int) AS xmin", "CAST(id * 104729 % 29989 AS int) AS ymin", "CAST(id * 7919 % 30011 AS int) + 20 AS xmax",
        "CAST(id * 104729 % 29989 AS int) + 12 AS ymax", "false AS is_cutoff",
    )
    r.relate(o.limit(100)).count()
    began = time.perf_counter()
    n = r.relate(o).count()
    members = r.clusters(o).count()
    assert time.perf_counter() - began < 40 and n > 100_000 and members > 1000


def test_components_of_groups_carry_their_columns(spark, monkeypatch):
    from groundphrase.operators import graph

    monkeypatch.setattr(graph, "CHUNK", 64)
    rng = random.Random(4)
    edges = [(f"g{k}", k * 1000 + rng.randrange(40), k * 1000 + rng.randrange(40)) for k in range(6) for _ in range(1 if k == 3 else 30 if k else 400)]
    got = {x.node: (x.k2, x.component, x.size) for x in components_within(spark.createDataFrame(edges, "k2 string, a long, b long"), "k2", carry=("k2",)).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    tops = {x: root(x) for x in list(up)}
    assert got == {x: (f"g{x // 1000}", t, list(tops.values()).count(t)) for x, t in tops.items()}
