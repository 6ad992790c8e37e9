"""Morphology of runs against the dense pictures and against a picture too large for one."""

import random

import pytest
from groundphrase.operators import masks as ms
from groundphrase.operators import raster as ra
from pyspark.sql import functions as F

KINDS = "k long, width int, height int, start long, length long"


def pixels(df, height):
    return {(r.k, r.x, r.y) for r in ra.from_runs(df, ["k"], height).collect()}


@pytest.mark.parametrize("steps", [[("dilate", 2)], [("erode", 1)], [("erode", 2), ("dilate", 2)], [("dilate", 3), ("erode", 3)], [("erode", 0)], []])
def test_same_as_dense_pictures(spark, steps):
    random.seed(9)
    w, h = 13, 9
    masks = {k: {(random.randrange(w), random.randrange(h)) for _ in range(n)} for k, n in ((1, 90), (2, 20), (3, 400), (4, 1))}
    masks[5] = {(x, y) for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(k, x, y) for k, m in masks.items() for x, y in m], "k long, x int, y int")
    runs = ra.to_runs(df, ["k"], h).withColumns({"width": F.lit(w), "height": F.lit(h)})
    got = ms.morph_runs(runs.unionByName(runs), ["k"], steps)
    assert pixels(got, h) == {(r.k, r.x, r.y) for r in ra.morph(df, ["k"], steps, w, h).collect()}
    joined = got.groupBy("k", "start").count().filter("count > 1").count()
    assert joined == 0
    again = ra.to_runs(ra.from_runs(got, ["k"], h), ["k"], h)
    assert sorted(map(tuple, got.select("k", "start", "length").collect())) == sorted(map(tuple, again.select("k", "start", "length").collect()))


def test_odd_masks(spark):
    rows = [(1, 4, 3, -5, 7), (1, 4, 3, 11, 50), (2, 4, 3, None, 4), (3, 0, 3, 0, 4), (4, None, 3, 0, 4), (5, 4, 3, 2, 0), (None, 2, 2, 0, 1), (6, 4, 3, 100, 4)]
    got = sorted(ms.morph_runs(spark.createDataFrame(rows, KINDS), ["k"], []).select("k", "start", "length").collect(), key=str)
    assert {tuple(r) for r in got} == {(1, 0, 2), (1, 11, 1), (None, 0, 1)}
    assert ms.morph_runs(spark.createDataFrame([], KINDS), ["k"], [("erode", 1)]).count() == 0
    with pytest.raises(ValueError):
        ms.morph_runs(spark.createDataFrame([], KINDS), ["k"], [("open", 1)])


def test_masks_of_different_pictures(spark):
    """Each mask keeps to its own picture's sides."""
    rows = [(1, 3, 3, 4, 1), (2, 9, 2, 0, 1)]
    got = ms.morph_runs(spark.createDataFrame(rows, KINDS), ["k"], [("dilate", 1)])
    assert {(r.k, r.start, r.length) for r in got.collect()} == {(1, 1, 1), (1, 3, 3), (1, 7, 1), (2, 0, 3)}


def test_a_picture_of_twenty_thousand_columns(spark):
    """A square, a thin line that opening takes, and a square at the corner: 4 * 10^8 pixels, of which none is a row."""
    side, radius = 20_000, 5
    block = lambda x0, y0, n: [(7, side, side, (x0 + i) * side + y0, n) for i in range(n)]
    line = [(7, side, side, x * side + 9_000, 3) for x in range(500, 12_500)]
    df = spark.createDataFrame(block(1_000, 2_000, 600) + block(side - 300, side - 300, 300) + line, KINDS)
    got = ms.morph_runs(df, ["k"], [("erode", radius), ("dilate", radius)])
    area = got.agg(F.sum("length")).first()[0]
    # what a square loses at a free corner: places that no disc inside the square covers
    inside = range(radius, 2 * radius + 1)
    lost = sum(all((x - a) ** 2 + (y - b) ** 2 > radius**2 for a in inside for b in inside) for x in range(radius) for y in range(radius))
    assert lost > 0 and area == 600 * 600 - 4 * lost + 300 * 300 - lost


def test_cleaning_as_on_pixels(spark):
    random.seed(4)
    df = spark.createDataFrame([(k, random.randrange(24), random.randrange(18)) for k in (1, 2, 3) for _ in range(330)], "k long, x int, y int").distinct()
    runs = ra.to_runs(df, ["k"], 18).withColumns({"width": F.lit(24), "height": F.lit(18)})
    want = {(r.k, r.x, r.y) for r in ra.clean_mask(df, "k", 1, 1, 12, 24, 18).collect()}
    assert want and pixels(ms.clean_runs(runs, "k", 1, 1, 12), 18) == want
