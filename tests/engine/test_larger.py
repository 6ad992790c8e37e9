"""Queries on tables that go beyond what the given sizes reach, against their DuckDB texts."""

import math
import os
import random

import duckdb
import pytest
from groundphrase.operators import graph as gr
from groundphrase.operators import masks as ms
from groundphrase.operators import phrases as ph
from groundphrase.operators import raster as ra
from groundphrase.operators import relations as r
from groundphrase.plans import catalog, rules
from groundphrase.plans.fixtures import load
from groundphrase.sources import patch_files as pf
from oracle import TABLES, same
from pyspark.sql import functions as F

SF, SQL = "/root/testdata/sf0.001", catalog.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A folder of the given tables, in which some are replaced by what a query of DuckDB gives."""

    def make(**tables):
        root = str(tmp_path_factory.mktemp("tables"))
        for t in TABLES.split():
            if t in tables:
                duckdb.sql(f"COPY ({tables[t]}) TO '{root}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", f"{root}/{t}.parquet")
        return root

    return make


#: 1,300 pictures of two pixels: more than 500 a domain.
PICTURES = "SELECT range // 2 * 400 + range % 2 AS event_id, range * range % 9973 AS user_id FROM range(2600)"


def test_the_bank_of_more_pictures_than_a_sample(spark, folder):
    root = folder(events=PICTURES)
    got = catalog.queries()["style_bank"](spark, root)
    assert [r.num_images for r in got.collect()] == [650, 650]
    same(got, SQL["style_bank"], root)


def test_the_written_bank_of_more_pictures_than_a_sample(spark, folder):
    root = folder(events=PICTURES)
    same(catalog.queries()["style_bank_roundtrip"](spark, root), SQL["style_bank_roundtrip"], root)


def test_moments_of_the_bank_of_more_pictures_than_a_sample(spark, folder):
    root = folder(events=PICTURES)
    same(catalog.queries()["raster_moment_transfer"](spark, root), SQL["raster_moment_transfer"], root)


def test_keys_that_reach_the_numbers_of_pairs(spark, folder):
    root = folder(orders=f"SELECT * REPLACE (o_orderkey + 1999000 AS o_orderkey) FROM '{SF}/orders.parquet'")
    same(catalog.queries()["target_metrics"](spark, root), SQL["target_metrics"], root)


def test_components_of_a_task_with_more_edges_than_are_held(spark):
    """Chains of seven nodes that are never null, more of them in a task than it solves at once."""
    e = spark.range(910_000).filter("id % 7 < 6").selectExpr("id div 7 AS g", "concat('c', id div 7 % 5) AS kind", "id AS a", "id + 1 AS b").coalesce(1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        found = gr.components_within(e, "g", carry=("g", "kind"))
        right = "size = 7 and component = g * 7 and node div 7 = g and kind = concat('c', g % 5)"
        assert found.selectExpr("count(*)", f"count_if({right})", "count(distinct node)").first() == (910_000, 910_000, 910_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("name", ["clean_mask", "group_grid_position", "group_phrases", "group_phrases_text", "group_relations", "unique_group_phrases"])
def test_queries_whose_tasks_have_more_edges_than_are_held(spark, monkeypatch, name):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(gr, "CHUNK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        same(catalog.queries()[name](spark, SF), SQL[name], SF)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_polygons_move_nothing_and_are_cut_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ra, "CUTS", 50)
    rng = random.Random(3)
    shapes = [[rng.uniform(-5, 30) if rng.random() < 0.7 else float(rng.randrange(30)) for _ in range(2 * rng.randrange(9) + rng.randrange(2))] for _ in range(200)]
    df = spark.createDataFrame([(i, s, 24, 20) for i, s in enumerate(shapes)] + [(900, None, 24, 20)], "polygon_id long, points array<double>, width int, height int")
    runs = ra.rasterize_runs(df.coalesce(1))
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, s in enumerate(shapes):
        p = list(zip(s[0::2], s[1::2], strict=False))
        for y in range(20 if len(p) > 2 else 0):
            cuts = sorted(a + (y + 0.5 - b) * (c - a) / (d - b) for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True) if (b <= y + 0.5) != (d <= y + 0.5))
            for l, r in zip(cuts[0::2], cuts[1::2], strict=True):
                want.add((i, y, max(0, math.ceil(l - 0.5)), min(24, math.ceil(r - 0.5))))
    assert sorted(map(tuple, runs.collect())) == sorted(w for w in want if w[2] < w[3])


def test_phrases_of_objects_do_not_move(spark):
    """Two patches, one of them dense for the bound given: both ways of meeting say the same as object_phrases(), and the texts, which
    are many more than the objects, are counted where they are made."""
    o = load(spark, SF, "objects").filter("patch_id < 4 and (patch_id <> 1 or pos < 5)")
    a = rules.attributed(o).withColumn("size_attribute", F.when(F.col("pos") == 3, "largest"))
    columns = ["patch_id", "object_id", "text", "dummy", "n"]
    for use_size in (False, True):
        want = ph.object_phrases(a, r.relate(o), use_size).groupBy(*columns[:4]).agg(F.count("*").alias("n"))
        for dense in (0, 10, 1000):
            assert sorted(map(tuple, ph.patch_phrases(a, use_size=use_size, dense=dense).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    plan = catalog.queries()["object_phrases"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text#" in line]


def test_patch_files_are_listed_without_a_task_for_every_few(spark, tmp_path):
    """600 files of "file:" are written by tasks themselves (no checksum files, no folder a file) and listed by one."""
    root = f"file:{tmp_path}/out"
    rows = spark.range(600).selectExpr("concat('P', id, ' é%=.xml') AS n", "concat('<annotation><filename>', id, '</filename></annotation>') AS t").repartition(5)
    assert pf.write_patch_files(rows, root, F.col("n"), F.col("t")) == 600
    assert not [f for f in os.listdir(f"{tmp_path}/out") if f.startswith(".P") or f.startswith(".staged")]
    found = pf.list_files(spark, root)
    assert found.rdd.getNumPartitions() == 1
    scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(root).select("path", "length")
    assert sorted(map(tuple, found.select("path", "length").collect())) == sorted(map(tuple, scan.collect()))
    assert {d.filename for d in pf.read_chosen(spark, found.filter("name like 'P7%'")).collect()} == {str(i) for i in range(600) if str(i)[0] == "7"}


def test_window_masks_some_at_a_time_without_sorting_runs(spark, monkeypatch):
    """Masks in parts, also of an object in two rows, are those of all at once; no run goes through a window or a sort of its own."""
    rng = random.Random(7)
    shape = lambda: [rng.choice([rng.uniform(-5, 70), float(rng.randint(0, 60))]) for _ in range(2 * rng.choice([1, 2, 3, 5, 9]))]
    many = [[shape(), shape()] for _ in range(60)]
    images = spark.createDataFrame([(0, 60, 50), (1, 41, 64)], "image_id int, width int, height int")
    kinds = "image_id int, object_id int, segmentation array<array<double>>, area double"
    whole = spark.createDataFrame([(i % 2, i, s, 50.0) for i, s in enumerate(many)], kinds)
    split = spark.createDataFrame([(i % 2, i, [p], 50.0) for i, s in enumerate(many) for p in s], kinds)
    out = ms.window_masks(images, whole, 20, 0.25)
    assert "Window " not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(ms, "HELD", 40)
    assert len(want) > 100 and sorted(map(tuple, ms.window_masks(images, split, 20, 0.25).collect())) == want
