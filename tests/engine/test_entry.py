"""The entry contract, and golden cases of the rules."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import pytest
from groundphrase.functions import geometry as g
from groundphrase.functions import phrases as p
from groundphrase.operators import phrases as ph
from groundphrase.operators import relations as r
from pyspark.sql import functions as F


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 170 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_queries_without_the_optional_parts(tmp_path):
    """The other queries stand when the llm folder is deleted, with or without the pipeline's file."""
    root = entry.__file__.rpartition("/")[0]
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and x != root)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 170 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env=env)
        (tmp_path / "copy/corpus_pipeline.py").unlink(missing_ok=True)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["combo", "n_unique"] and df.count() > 0


def box(i, x, y, category="ship", patch=1, size=10, cut=False):
    return (i, patch, i, category, x, y, x + size, y + size, cut)


COLUMNS = "object_id long, patch_id long, pos int, category string, xmin int, ymin int, xmax int, ymax int, is_cutoff boolean"


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


@pytest.mark.parametrize(("angle", "mode", "border", "said"), [
    (170.0, "reference", False, ["to the bottom right of"]), (170.0, "eight", True, ["to the right of", "to the bottom right of"]),
    (180.0, "reference", False, ["to the bottom right of"]), (180.0, "eight", False, ["to the right of"]),
    (20.0, "reference", True, ["to the left of", "to the bottom left of"]), (0.0, "reference", False, ["to the left of"]),
    (22.5, "reference", True, ["to the left of", "to the bottom left of"]), (-175.0, "reference", True, ["to the right of"]),
])
def test_directions(spark, angle, mode, border, said):
    b, first, second = g.directions(F.col("a"), mode)
    row = spark.createDataFrame([(angle,)], "a double").select(b.alias("b"), F.array_compact(F.array(first, second)).alias("d")).first()
    assert (row.b, row.d) == (border, said)


def test_sectors_by_their_definition(spark):
    """Every half degree, and the edges, against the list of ranges."""
    near = lambda a, edge: abs(a - edge) < g.OVERLAP

    def brute(a):
        here = [s for s in g.SECTORS if s[1] <= a <= s[2]]
        said = [n for s in here for n in [s[0], *(o[0] for o in g.SECTORS if (near(a, s[1]) and o[2] == s[1]) or (near(a, s[2]) and o[1] == s[2]))]]
        return any(near(a, s[1]) or near(a, s[2]) for s in here), list(dict.fromkeys(said)) or ["to the bottom right of"]

    b, first, second = g.directions(F.col("a"))
    df = spark.range(-360, 361).select((F.col("id") / 2).alias("a"))
    for r in df.select("a", b.alias("b"), F.array_compact(F.array(first, second)).alias("d")).collect():
        assert (r.b, r.d) == brute(r.a), r


def test_unique_phrases_in_one_pass_are_those_of_the_steps(spark):
    o = objects(spark, *[box(i, (i * i * 37) % 400, (i * 91) % 400, ("ship", "plane", "Large_Vehicle")[i % 3], i % 4, 10 + i % 7, i % 11 == 0) for i in range(60)])
    at = r.with_extremes(g.with_geometry(o), 480, 480).withColumns({
        "grid_position": g.grid_position(F.col("cx"), F.col("cy"), F.lit(480), F.lit(480)), "is_ambiguous": F.expr("object_id % 4 = 1"),
        "size_attribute": F.expr("if(object_id % 6 = 0, 'largest', null)"),
        "colours": F.expr("CASE object_id % 4 WHEN 0 THEN array('light') WHEN 1 THEN array('light', 'Dark') WHEN 2 THEN null ELSE array() END")})
    for use_size in (False, True):
        steps = ph.unique_phrases(ph.object_phrases(at, r.relate(o), use_size)).drop("pos")
        one = ph.unique_object_phrases(at, use_size=use_size)
        assert steps.columns == ["patch_id", "object_id", "text"] and sorted(steps.collect()) == sorted(one.select(*steps.columns).collect()) != []


def kept(spark, o, colours="array()", ambiguous="false"):
    a = g.with_geometry(o).withColumns({
        "grid_position": g.grid_position(F.col("cx"), F.col("cy"), F.lit(480), F.lit(480)), "extreme_position": F.lit(None).cast("string"),
        "size_attribute": F.lit(None).cast("string"), "colours": F.expr(colours).cast("array<string>"), "is_ambiguous": F.expr(ambiguous)})
    rows = ph.unique_phrases(ph.object_phrases(a, r.relate(o))).collect()
    return sorted((x.object_id, x.text) for x in rows)


def test_borderline_relations_cancel_out(spark):
    import math

    dx, dy = round(100 * math.cos(math.radians(20))), round(100 * math.sin(math.radians(20)))
    o = objects(spark, box(1, 100, 300), box(2, 100 + dx, 300 - dy, "plane"))
    assert not [t for _, t in kept(spark, o) if "that is" in t]


def test_colours(spark):
    plane = objects(spark, box(1, 200, 200, "plane"))
    assert kept(spark, plane, "array('light')") == [(1, "the light plane"), (1, "the light plane in the center")]
    assert kept(spark, plane, "array('light', 'dark')", "true") == [(1, "the plane"), (1, "the plane in the center")]
    building = objects(spark, box(1, 200, 200, "building"))
    assert kept(spark, building, "array('green')") == [(1, "the building"), (1, "the building in the center")]


def test_cut_off_objects_distract(spark):
    o = objects(spark, box(1, 30, 30), box(2, 60, 30, cut=True))
    assert not [t for _, t in kept(spark, o) if "that is" not in t]
    both = objects(spark, box(1, 30, 30, patch=1), box(2, 30, 30, patch=2))
    assert [i for i, t in kept(spark, both) if t == "the ship"] == [1, 2]


def test_clusters_of_nine_dissolve(spark):
    chain = lambda n, first=1, y=0: [box(first + i, 20 * i, y) for i in range(n)]
    got = r.clusters(objects(spark, *chain(9), *chain(8, 100, 200))).collect()
    assert {x.object_id for x in got} == set(range(100, 108)) and {x.component for x in got} == {100}
    dense = r.clusters(objects(spark, *chain(3), box(50, 300, 300), box(51, 320, 300)), min_samples=3).collect()
    assert {x.object_id for x in dense} == {1, 2, 3}


def test_words(spark):
    said = ["group of 3 ship", "group of 3 building", "group of 1 Large_Vehicle", "All plane in the image", "group of 12 Bridge and group of 2 storage_tank"]
    df = spark.createDataFrame([(x,) for x in said], "t string").select(p.standardize_phrase(F.col("t")).alias("s"))
    assert [x.s for x in df.collect()] == ["group of 3 ships", "group of 3 building", "large vehicle", "all planes in the image", "group of 12 bridges and group of 2 storage tanks"]
    at = spark.range(1).select(g.grid_position(F.lit(160.0), F.lit(160.0), F.lit(480), F.lit(480)).alias("g")).first()
    assert at.g == "in the center"
