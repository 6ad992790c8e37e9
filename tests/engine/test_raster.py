"""Pictures of real size, and shapes against plain Python."""

import math
import os
import random
import time

from groundphrase.operators import raster as ra
from pyspark.sql import functions as F


def test_pictures_of_480_pixels_are_unpacked_in_seconds(spark):
    side, data = 480, [os.urandom(480 * 480 * 3) for _ in range(4)]
    df = spark.createDataFrame([(i, side, side, bytearray(d)) for i, d in enumerate(data)], "image_id int, width int, height int, data binary")
    began = time.perf_counter()
    got = ra.unpack(df).filter("x in (0, 7, 479) and y in (0, 300, 479)").collect()
    assert time.perf_counter() - began < 30 and len(got) == 36
    for r in got:
        at = (r.y * side + r.x) * 3
        assert (r.b, r.g, r.r) == tuple(data[r.image_id][at : at + 3])


def test_polygons_against_the_rule(spark):
    random.seed(3)
    shapes = {i: [random.uniform(-5, 35) for _ in range(2 * random.randint(3, 7))] for i in range(25)} | {100: [1.0, 1.0, 5.0], 101: [2.0, 2.0, 8.0, 2.0, 8.0, 8.0, 2.0, 8.0]}
    df = spark.createDataFrame([(i, p, 30, 28) for i, p in shapes.items()] + [(102, None, 30, 28)], "polygon_id int, points array<double>, width int, height int")
    got = {(r.polygon_id, r.x, r.y) for r in ra.rasterize(df).collect()}
    want = set()
    for i, p in shapes.items():
        pts = list(zip(p[::2], p[1::2]))
        if len(pts) < 3:
            continue
        for y in range(28):
            cuts = sorted(a[0] + (y + 0.5 - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(pts, pts[1:] + pts[:1]) if (a[1] <= y + 0.5) != (b[1] <= y + 0.5))
            want |= {(i, x, y) for a, b in zip(cuts[::2], cuts[1::2]) for x in range(30) if math.ceil(a - 0.5) <= x < math.ceil(b - 0.5)}
    assert got == want and {(101, x, y) for x in range(2, 8) for y in range(2, 8)} <= got


def test_solidity(spark):
    square = [(1, x, y) for x in range(5) for y in range(5)]
    corner = [(2, x, y) for x in range(6) for y in range(6) if x == 0 or y == 0]
    rows = square + corner + [(3, x, 0) for x in range(4)]
    got = {r.k: (r.area, r.aspect, r.solidity) for r in ra.shape_stats(spark.createDataFrame(rows, "k int, x int, y int"), ["k"]).collect()}
    assert got[1] == (25, 1.0, 25 / 16) and got[3] == (4, 4.0, 0.0)
    assert got[2][:2] == (11, 1.0) and abs(got[2][2] - 11 / 12.5) < 1e-9


def test_steps_against_pixel_sets(spark):
    random.seed(5)
    w, h = 14, 11
    masks = {k: {(random.randrange(w), random.randrange(h)) for _ in range(70)} for k in range(3)}
    df = spark.createDataFrame([(k, x, y) for k, m in masks.items() for x, y in m] + [(0, -1, 3), (0, w, 3)], "k long, x int, y int")
    disc = [(a, b) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2) if a * a + b * b <= 4]
    inside = lambda p: 0 <= p[0] < w and 0 <= p[1] < h
    grow = lambda m: {q for x, y in m for a, b in disc if inside(q := (x + a, y + b))}
    shrink = lambda m: {(x, y) for x in range(w) for y in range(h) if all(not inside((x + a, y + b)) or (x + a, y + b) in m for a, b in disc)}
    for op, f in ((ra.dilate, grow), (ra.erode, shrink), (ra.opening, lambda m: grow(shrink(m))), (ra.closing, lambda m: shrink(grow(m)))):
        got = {k: set() for k in masks}
        for r in op(df, ["k"], 2, w, h).collect():
            got[r.k].add((r.x, r.y))
        assert got == {k: f(m) for k, m in masks.items()}
    assert ra.closing(df.filter(F.lit(False)), ["k"], 1, w, h).count() == 0
