"""Pictures as blocks against the same operators on tables of pixels, and pictures of real size."""

import os
import time

import pytest
from groundphrase.operators import blocks as bl
from groundphrase.operators import raster as ra
from pyspark.sql import functions as F

KINDS = "image_id long, width int, height int, data binary"


@pytest.fixture(scope="module")
def pictures(spark):
    """Three pictures of odd sizes: noise, a flat one, and one pixel."""
    rows = [(1, 23, 17, os.urandom(23 * 17 * 3)), (2, 9, 31, bytes([7, 90, 200]) * (9 * 31)), (3, 1, 1, b"\x01\x02\x03")]
    return spark.createDataFrame([(i, w, h, bytearray(d)) for i, w, h, d in rows], KINDS)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select("image_id", "x", "y", *names).collect())


def gray(pixels):
    return pixels.select("image_id", "x", "y", ra.gray().alias("v"))


@pytest.mark.parametrize("limit", [1, 150, 1 << 20])
def test_blocks_hold_whole_rows_and_give_the_pictures_back(spark, pictures, limit):
    b = bl.to_blocks(pictures, limit=limit)
    for r in b.collect():
        assert len(r.data) == r.rows * r.width * 3 and (len(r.data) <= limit or r.rows == 1)
    back = {r.image_id: bytes(r.data) for r in bl.to_pictures(b).collect()}
    assert back == {r.image_id: bytes(r.data) for r in pictures.collect()}
    assert rows(bl.pixels_of(b), "b", "g", "r") == rows(ra.unpack(pictures), "b", "g", "r")


def test_unsound_pictures_give_no_block(spark):
    odd = [(1, 2, 2, bytearray(5)), (2, 0, 2, bytearray()), (3, 2, 2, None), (4, None, 2, bytearray(12)), (None, 2, 2, bytearray(12))]
    got = bl.to_blocks(spark.createDataFrame(odd, KINDS)).collect()
    assert [(r.image_id, len(r.data)) for r in got] == [(None, 12)]
    none = bl.to_blocks(spark.createDataFrame([], KINDS))
    assert bl.pixels_of(bl.sepia(none)).count() == 0 and bl.levels(none).count() == 0


def test_same_as_on_pixels(pictures):
    b, p = bl.to_blocks(pictures, limit=200), ra.unpack(pictures)
    g, v = bl.gray(b), gray(p)
    same = lambda x, names, y, other=None: rows(bl.pixels_of(x, names), *names) == rows(y, *(other or names))
    assert same(g, ("v",), v)
    assert same(bl.contrast_gamma(g, 0.85, 1.1), ("out",), ra.contrast_gamma(v, 0.85, 1.1))
    assert same(bl.sepia(b), ("s_b", "s_g", "s_r"), ra.sepia(p))
    assert same(bl.to_hsv(b), ("h", "s", "v"), ra.to_hsv(p))
    assert same(bl.vignette(g, size=(23, 17)), ("out",), ra.vignette(v, 23, 17))
    runs = p.filter("(x + y) % 3 = 0 and x < 5").select("image_id", "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1"))
    outside = runs.selectExpr("image_id", "y + 100 AS y", "x0", "x1").unionByName(runs.selectExpr("image_id", "y", "-4 AS x0", "0 AS x1"))
    assert same(bl.overlay(b, runs.unionByName(runs).unionByName(outside)), ("o_b", "o_g", "o_r"), ra.overlay(p, p.filter("(x + y) % 3 = 0 and x < 5")))
    boxes = p.select("image_id").distinct().selectExpr("image_id", "2 AS xmin", "3 AS ymin", "7 AS xmax", "30 AS ymax")
    assert same(bl.highlight(b, boxes), ("o_b", "o_g", "o_r"), ra.highlight(p, boxes))
    m, own = bl.moments(bl.levels(b)), ra.moments(p)
    for x, y in zip(m.orderBy("image_id").collect(), own.orderBy("image_id").collect(), strict=True):
        assert all(abs(x[k] - y[k]) < 1e-9 for k in own.columns)
    bank = own.select((F.col("image_id") % 3 + 1).alias("image_id"), *own.columns[1:])
    assert same(bl.moment_transfer(b, bank), ("t_b", "t_g", "t_r"), ra.moment_transfer(p, bank))
    pairs = p.select("image_id").distinct().withColumn("target_id", F.col("image_id") % 3 + 1)
    looked = v.join(ra.match_histogram(v, pairs).withColumnRenamed("level", "v"), ["image_id", "v"])
    assert same(bl.match_histogram(g, pairs), ("out",), looked, ("matched",))
    # flat channels: two ways of adding differ in their last digits, so only varied pictures are compared in L*a*b*
    lab = ra.moments(ra.to_lab(p.filter("image_id = 1")), bl.LAB)
    got, want = bl.lab_moments(b.filter("image_id = 1")).first(), lab.first()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in lab.columns)
    moved = ra.moment_transfer_lab(p.filter("image_id = 1"), lab.withColumn("m_l", F.col("m_l") + 3))
    assert same(bl.moment_transfer_lab(b, lab.withColumn("m_l", F.col("m_l") + 3)), ("t_b", "t_g", "t_r"), moved)
    assert [r.image_id for r in bl.too_black(b).collect()] == [3]


def test_tiles(pictures):
    b = bl.to_blocks(pictures.filter("image_id = 1"), limit=100)
    want = ra.tile_resize(ra.unpack(pictures.filter("image_id = 1")), 16, 20, "g")
    t = bl.tile_resize(b, 16, 20)
    got = []
    for k in range(4):
        got += [(k, *p) for p in rows(bl.pixels_of(t.filter(F.col("tile") == k)), "g")]
    assert sorted(got) == sorted((r.tile, r.image_id, r.x, r.y, r.g) for r in want.collect())
    assert bl.tile_resize(b, 16, 7).count() == 0


def test_noise_is_the_same_in_any_blocks(pictures):
    few, many = (bl.gray(bl.to_blocks(pictures, limit=n)) for n in (1 << 20, 1))
    for f in (bl.film_grain, bl.uniform_noise):
        assert rows(bl.pixels_of(f(few, seed=4), ("v",)), "v") == rows(bl.pixels_of(f(many, seed=4), ("v",)), "v")
        assert rows(bl.pixels_of(f(few, seed=4), ("v",)), "v") != rows(bl.pixels_of(f(few, seed=5), ("v",)), "v")
    grown = bl.pixels_of(bl.uniform_noise(few), ("o",)).join(bl.pixels_of(few, ("v",)), ["image_id", "x", "y"])
    assert grown.filter("o < v or o > v + 49 or o > 255").count() == 0 and grown.filter("o > v").count() > 0


def test_a_hundred_pictures_of_480_pixels_in_seconds(spark):
    side = 480
    data = [(i, side, side, bytearray(os.urandom(side * side * 3))) for i in range(100)]
    b = bl.to_blocks(spark.createDataFrame(data, KINDS).repartition(8))
    began = time.perf_counter()
    d = bl.contrast_gamma(bl.gray(bl.sepia(b)), 0.85, 1.1)
    assert d.agg(F.sum(F.octet_length("data"))).first()[0] == 100 * side * side
    assert time.perf_counter() - began < 60
