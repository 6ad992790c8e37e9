"""Masks as runs against masks as sets of pixels."""

import math
import random

from groundphrase.operators import masks as ms
from groundphrase.operators import matching as ma
from pyspark.sql import functions as F


def polygon(points, width, height):
    """Pixels in or on a polygon, one by one."""
    p = [(int(x), int(y)) for x, y in zip(points[::2], points[1::2])]
    edges = list(zip(p, p[1:] + p[:1]))
    on = set()
    for (ax, ay), (bx, by) in edges:
        if abs(bx - ax) >= abs(by - ay):
            for x in range(min(ax, bx), max(ax, bx) + 1):
                on.add((x, math.floor((ay + (x - ax) * (by - ay) / (bx - ax) if bx != ax else ay) + 0.5)))
        else:
            for y in range(min(ay, by), max(ay, by) + 1):
                on.add((math.floor(ax + (y - ay) * (bx - ax) / (by - ay) + 0.5), y))
    for x in range(width):
        cuts = sorted(ay + (x - ax) * (by - ay) / (bx - ax) for (ax, ay), (bx, by) in edges if (ax <= x) != (bx <= x))
        for a, b in zip(cuts[::2], cuts[1::2]):
            on |= {(x, y) for y in range(math.ceil(a), math.floor(b) + 1)}
    return {(x, y) for x, y in on if 0 <= x < width and 0 <= y < height}


def shapes(seed, n):
    rng = random.Random(seed)
    one = lambda: [rng.choice([rng.uniform(-5, 70), float(rng.randint(0, 60))]) for _ in range(2 * rng.choice([1, 2, 3, 4, 5, 8]))]
    return {i: [one() for _ in range(rng.randint(1, 3))] for i in range(n)}


def test_masks_in_windows(spark):
    sizes = {0: (60, 50), 1: (41, 64), 2: (20, 19)}
    found = shapes(5, 60)
    images = spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image_id int, width int, height int")
    rows = [(i % 3, i, p, float(i * 7 % 400) if i % 5 else None) for i, p in found.items()] + [(0, 100, [], 3.0), (1, 101, None, 3.0), (1, 102, [None, [1.0]], 0.0)]
    a = spark.createDataFrame(rows, "image_id int, object_id int, segmentation array<array<double>>, area double")
    got = ms.window_masks(images, a, 20, 0.25, 0.5, 90).collect()
    want = {}
    for image, obj, polygons, area in rows:
        width, height = sizes[image]
        mask = set().union(*[polygon(p, width, height) for p in polygons or [] if p and len(p) > 1])
        for ix in range((width - 20) // 15 + 1 if width >= 20 else 0):
            for iy in range((height - 20) // 15 + 1 if height >= 20 else 0):
                here = {(x - ix * 15, y - iy * 15) for x, y in mask if 0 <= x - ix * 15 < 20 and 0 <= y - iy * 15 < 20}
                if here:
                    xs, ys = zip(*here)
                    cutoff = bool(area) and len(here) / area < 0.5 and len(here) < 90
                    want[image, obj, ix, iy] = (here, (min(xs), min(ys), max(xs) + 1, max(ys) + 1), cutoff)
    assert {(r.image_id, r.object_id, r.ix, r.iy) for r in got} == want.keys() and len(want) > 100
    for r in got:
        here, box, cutoff = want[r.image_id, r.object_id, r.ix, r.iy]
        assert {(p // 20, p % 20) for s in r.runs for p in range(s.start, s.start + s.length)} == here
        assert all(a.start + a.length < b.start for a, b in zip(r.runs, r.runs[1:]))
        assert (r.area, (r.xmin, r.ymin, r.xmax, r.ymax), r.is_cutoff) == (len(here), box, cutoff)


def test_some_windows_only(spark):
    images = spark.createDataFrame([(0, 50, 50)], "image_id int, width int, height int")
    a = spark.createDataFrame([(0, 1, [[0.0, 0.0, 49.0, 0.0, 49.0, 49.0, 0.0, 49.0]], 2500.0)], "image_id int, object_id int, segmentation array<array<double>>, area double")
    windows = ma.image_windows(images, 20, 0.25).filter("ix = iy")
    got = ms.window_masks(images, a, 20, 0.25, windows=windows).collect()
    assert {(r.ix, r.iy, r.area, len(r.runs)) for r in got} == {(0, 0, 400, 1), (1, 1, 400, 1), (2, 2, 400, 1)}


def test_counts(spark):
    rows = [([(0, 3), (5, 2)],), ([(2, 1), (6, 4)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start: long, length: long>>")
    assert [r[0] for r in df.select(ms.coco_counts(F.col("runs"), 10)).collect()] == [[0, 3, 2, 2, 3], [2, 1, 3, 4], [10]]


def test_overlaps_of_masks(spark):
    rng = random.Random(2)
    runs = lambda: [(rng.randrange(200), rng.randint(1, 30)) for _ in range(rng.randint(0, 9))]
    masks = {i: (runs(), runs()) for i in range(50)}
    tables = [spark.createDataFrame([(i, s, n) for i, m in masks.items() for s, n in m[k]], "id int, start long, length long") for k in (0, 1)]
    got = {r.id: (r.inter, r.union_) for r in ms.run_overlap(*tables, ["id"], spark.range(51).selectExpr("cast(id as int) as id")).collect()}
    places = lambda m: {p for s, n in m for p in range(s, s + n)}
    want = {i: (len(places(a) & places(b)), len(places(a) | places(b))) for i, (a, b) in masks.items()}
    assert got == want | {50: (0, 0)}
