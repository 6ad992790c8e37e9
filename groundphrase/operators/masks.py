"""Masks as tables of runs: polygons to runs, runs cut by windows, overlaps of two masks. No row is a pixel.

A run is (start, length) of places x * height + y, column after column, the order of COCO's run-length codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.operators.graph import components_within
from groundphrase.operators.lineage import cut
from groundphrase.operators.matching import window_index
from groundphrase.operators.raster import union_runs


def polygon_columns(polygons: DataFrame, key: list[str]) -> DataFrame:
    """(key, x, y0, y1): runs y0..y1 - 1 in column x of the pixels inside or on a polygon, cut to the picture.

    polygons: key (with width and height) and points (x0, y0, x1, y1, ...), whose fractions are cut off. Pixels are points at
    whole coordinates. Inside is the even-odd rule, ends included; the outline is each edge's nearest pixels, one a column on flat
    edges and one a row on steep ones. One point or two give a dot or a line. Null points or fewer give nothing. A column may
    have several runs, which may overlap.
    """
    n = F.floor(F.size("points") / 2).cast("int")
    at = lambda i: F.get("points", i).cast("int").cast("double")
    point = lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(point(i).alias("p"), point((i + 1) % n).alias("q")))
    e = polygons.filter(n >= 1).select(*key, F.explode(edge).alias("e")).select(*key, "e.p", "e.q")
    low, high = F.least("p.x", "q.x").cast("int"), F.greatest("p.x", "q.x").cast("int")
    first, last = F.greatest(F.lit(0), low), F.least(F.col("width").cast("int") - 1, high)
    columns = e.filter(first <= last).withColumn("x", F.explode(F.sequence(first, last)))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    line = lambda x: F.col("p.y") + (x - F.col("p.x")) * dy / F.nullif(dx, F.lit(0.0))
    top, bottom = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    before, after = line(F.col("x") - 0.5), line(F.col("x") + 0.5)
    flat = F.floor(line(F.col("x")) + 0.5)
    y0 = F.when(dx == 0, top).when(F.abs(dx) >= F.abs(dy), flat).when(dy * dx > 0, F.greatest(F.ceil(before), top)).otherwise(F.greatest(F.floor(after) + 1, top))
    y1 = F.when(dx == 0, bottom).when(F.abs(dx) >= F.abs(dy), flat).when(dy * dx > 0, F.least(F.ceil(after) - 1, bottom)).otherwise(F.least(F.floor(before), bottom))
    run = lambda y0, y1: F.struct(y0.cast("bigint").alias("y0"), (y1.cast("bigint") + 1).alias("y1"))
    crossed = (F.col("p.x") <= F.col("x")) != (F.col("q.x") <= F.col("x"))
    by_column = columns.groupBy(*key, "x").agg(
        F.sort_array(F.collect_list(F.when(crossed, line(F.col("x"))))).alias("c"), F.collect_set(run(y0, y1)).alias("outline")
    )
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: run(F.ceil(F.get("c", 2 * i)), F.floor(F.get("c", 2 * i + 1))))
    inside = F.when(F.size("c") > 0, pairs).otherwise(F.array().cast("array<struct<y0:bigint,y1:bigint>>"))
    both = by_column.select(*key, "x", F.explode(F.concat(inside, "outline")).alias("r"))
    return both.select(*key, "x", F.greatest(F.lit(0), "r.y0").alias("y0"), F.least("height", "r.y1").alias("y1")).filter("y0 < y1")


def cut_runs(runs: DataFrame, patch: int, step: int) -> DataFrame:
    """Column runs (x, y0, y1, width, height and what else there is) in every window that they meet, as (ix, iy, start, length)
    in the window's own places. A run meets an interval of windows along either side, so nothing is joined."""
    own = [c for c in runs.columns if c not in ("x", "y0", "y1", "width", "height")]
    d = runs.withColumn("ix", F.explode(window_index(F.col("x"), F.col("x") + 1, F.col("width"), patch, step)))
    d = d.withColumn("iy", F.explode(window_index(F.col("y0"), F.col("y1"), F.col("height"), patch, step)))
    top, bottom = F.greatest(F.lit(0), F.col("y0") - F.col("iy") * step), F.least(F.lit(patch), F.col("y1") - F.col("iy") * step)
    return d.select(*own, "ix", "iy", ((F.col("x") - F.col("ix") * step) * patch + top).alias("start"), (bottom - top).alias("length"))


def run_stats(runs: DataFrame, key: list[str], height: int) -> DataFrame:
    """(key, area, xmin, ymin, xmax, ymax, runs): sums and boxes (ends excluded) of masks whose runs don't overlap."""
    last = F.col("start") + F.col("length") - 1
    left, right = F.floor(F.col("start") / height), F.floor(last / height)
    return runs.groupBy(*key).agg(
        F.sum("length").alias("area"), F.min(left).cast("int").alias("xmin"), F.min(F.when(left == right, F.col("start") % height).otherwise(0)).cast("int").alias("ymin"),
        (F.max(right) + 1).cast("int").alias("xmax"), F.max(F.when(left == right, last % height + 1).otherwise(height)).cast("int").alias("ymax"),
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"),
    )


def window_masks(
    images: DataFrame, annotations: DataFrame, patch: int = 480, overlap: float = 0.2, share: float = 0.5, least: int = 500, windows: DataFrame | None = None
) -> DataFrame:
    """(image_id, ix, iy, object_id, source_area, area, xmin, ymin, xmax, ymax, runs, is_cutoff): the masks of annotations in each
    sliding window that they show in, one row for each.

    images: image_id, width, height; annotations: image_id, object_id, segmentation (an array of polygons, whose union is the mask)
    and area. Windows are those of image_windows(), or some of them. Area, box and runs are those of the part of the mask
    inside, in the window's own places; a mask is cut off if less than `share` of the annotation's area and fewer than `least`
    pixels show. Without an area, or with none, nothing is cut off. Polygons without points and images smaller than a window
    give no row.
    """
    step = max(1, int(patch * (1 - overlap)))
    key = ["image_id", "object_id", "source_area"]
    sides = annotations.join(images.filter(F.least("width", "height") >= patch).select("image_id", "width", "height"), "image_id")
    # this exchange, of polygons, is the only one, and as wide as can be; what an object has in several rows comes together
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = sides.repartition(parts, "image_id", "object_id").withColumnRenamed("area", "source_area")
    one = sides.groupBy(*key, "width", "height").agg(F.flatten(F.collect_list("segmentation")).alias("segmentation"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [pc.cast(batch.column(i), pa.int64()).to_numpy(zero_copy_only=False) for i in (3, 4)]
            for row, numbers, runs in _masks_in_windows(batch.column(5), *side, patch, step):
                at = pa.array(row)
                told = [pa.array(a).cast(k) for a, k in zip(numbers, [pa.int64()] * 3 + [pa.int32()] * 4, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], *told, runs], [*key, "ix", "iy", "area", *_BOX, "runs"])

    kinds = ", ".join(f"`{k}` {one.schema[k].dataType.simpleString()}" for k in key)
    out = one.mapInArrow(work, f"{kinds}, ix bigint, iy bigint, area bigint, {', '.join(f'{k} int' for k in _BOX)}, runs array<struct<start:bigint,length:bigint>>")
    if windows is not None:
        out = out.join(windows.select("image_id", "ix", "iy"), ["image_id", "ix", "iy"], "left_semi").select(out.columns)
    hidden = (F.try_divide("area", "source_area") < share) & (F.col("area") < least)
    return out.withColumn("is_cutoff", F.coalesce(hidden, F.lit(False)))


_BOX = ("xmin", "ymin", "xmax", "ymax")
#: Columns of edges that are held at a time, if a mask has no more.
HELD = 1 << 19


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): first, first + 1, ... of each, count of them."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _masks_in_windows(segmentation: pa.Array, width: np.ndarray, height: np.ndarray, patch: int, step: int) -> Iterator[tuple]:
    """(row, numbers, runs) of the masks of a batch in their windows, some at a time: polygon_columns(), cut_runs(), union_runs() and
    run_stats() in arrays. numbers: ix, iy, area and box."""
    polygons = segmentation.flatten()
    size = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    many = pc.fill_null(pc.list_value_length(segmentation), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = np.trunc(pc.cast(polygons.flatten(), pa.float64()).to_numpy(zero_copy_only=False))  # null: NaN
    n, start = size // 2, np.cumsum(size) - size
    poly, k = _spread(np.zeros(len(n), np.int64), n)
    p, q = start[poly] + 2 * k, start[poly] + 2 * np.where(k + 1 == n[poly], 0, k + 1)
    px, py, qx, qy = v[p], v[p + 1], v[q], v[q + 1]
    known = ~np.isnan(px + py + qx + qy)
    poly, px, py, qx, qy = (a[known] for a in (poly, px, py, qx, qy))
    row = np.repeat(np.arange(len(many)), many)[poly]
    first = np.maximum(0, np.minimum(px, qx))
    count = np.maximum(0, np.minimum(width[row] - 1, np.maximum(px, qx)) - first + 1).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(count)])
    last = np.append(np.flatnonzero(np.diff(row)), len(row) - 1) + 1 if len(row) else []  # where masks end
    at = 0
    for i, end in enumerate(last):
        if i + 1 == len(last) or upto[last[i + 1]] - upto[at] > HELD:
            part = slice(at, end)
            at = end
            if found := _in_windows(*(a[part] for a in (row, poly, px, py, qx, qy, first, count)), width, height, patch, step):
                yield found


def _in_windows(row, poly, px, py, qx, qy, first, count, width, height, patch: int, step: int) -> tuple | None:
    e, x = _spread(first, count)
    row, poly, px, py, qx, qy = (a[e] for a in (row, poly, px, py, qx, qy))
    dx, dy, top, bottom = qx - px, qy - py, np.minimum(py, qy), np.maximum(py, qy)
    with np.errstate(divide="ignore", invalid="ignore"):
        line = lambda x: py + (x - px) * dy / dx
        before, at, after = line(x - 0.5), line(x), line(x + 0.5)
    cases = [dx == 0, np.abs(dx) >= np.abs(dy), dy * dx > 0]
    y0 = np.select(cases, [top, np.floor(at + 0.5), np.maximum(np.ceil(before), top)], np.maximum(np.floor(after) + 1, top))
    y1 = np.select(cases, [bottom, np.floor(at + 0.5), np.minimum(np.ceil(after) - 1, bottom)], np.minimum(np.floor(before), bottom))
    crossed = np.flatnonzero((px <= x) != (qx <= x))
    crossed = crossed[np.lexsort((at[crossed], x[crossed], poly[crossed]))]
    c, of, column = at[crossed], poly[crossed], x[crossed]
    new = np.ones(len(c), bool)
    new[1:] = (of[1:] != of[:-1]) | (column[1:] != column[:-1])
    rank = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    left = np.flatnonzero((rank[:-1] % 2 == 0) & ~new[1:])
    row, x = np.concatenate([row, row[crossed[left]]]), np.concatenate([x, column[left]]).astype(np.int64)
    y0 = np.maximum(0, np.concatenate([y0, np.ceil(c[left])])).astype(np.int64)
    y1 = np.minimum(height[row], np.concatenate([y1, np.floor(c[left + 1])]) + 1).astype(np.int64)
    some = y0 < y1
    row, x, y0, y1 = (a[some] for a in (row, x, y0, y1))

    def met(low: np.ndarray, high: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """matching.window_index()"""
        lo, hi = np.maximum(0, (low - patch) // step + 1), np.minimum((sides - patch) // step, -(-high // step) - 1)
        return _spread(lo, np.maximum(0, hi - lo + 1))

    w, ix = met(x, x + 1, width[row])
    row, x, y0, y1 = (a[w] for a in (row, x, y0, y1))
    w, iy = met(y0, y1, height[row])
    row, x, y0, y1, ix = (a[w] for a in (row, x, y0, y1, ix))
    if not len(row):
        return None
    y0, y1 = np.maximum(0, y0 - iy * step), np.minimum(patch, y1 - iy * step)
    begin = (x - ix * step) * patch + y0
    order = np.lexsort((begin, iy, ix, row))
    row, ix, iy, begin, length = (a[order] for a in (row, ix, iy, begin, y1 - y0))
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (ix[1:] != ix[:-1]) | (iy[1:] != iy[:-1])
    base = (np.cumsum(head) - 1) * (patch * patch + 2)  # masks after each other, so that one running maximum serves all
    ends = np.maximum.accumulate(base + begin + length)
    island = head.copy()
    island[1:] |= base[1:] + begin[1:] > ends[:-1]
    lead = np.flatnonzero(island)
    begin, over = begin[lead], (ends - base)[np.append(lead[1:], len(row)) - 1]
    mask = np.flatnonzero(head[lead])
    l, r, tail = begin // patch, (over - 1) // patch, (over - 1) % patch + 1
    numbers = [ix[lead][mask], iy[lead][mask], np.add.reduceat(over - begin, mask), np.minimum.reduceat(l, mask), np.minimum.reduceat(np.where(l == r, begin % patch, 0), mask),
               np.maximum.reduceat(r, mask) + 1, np.maximum.reduceat(np.where(l == r, tail, patch), mask)]
    runs = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(over - begin, pa.int64())], ["start", "length"])
    return row[lead][mask], numbers, pa.ListArray.from_arrays(pa.array(np.append(mask, len(lead)), pa.int32()), runs)


def _columns(start: Column, length: Column, height: Column) -> Column:
    """Runs (x, y0, y1) of a run of places, one in each column that it reaches; its length is not 0."""
    x0 = F.floor(start / height)
    one = lambda x: F.struct(x.alias("x"), F.greatest(F.lit(0).cast("bigint"), start - x * height).alias("y0"), F.least(height, start + length - x * height).alias("y1"))
    return F.transform(F.sequence(x0, F.floor((start + length - 1) / height)), one)


def _merged(columns: DataFrame, key: list[str]) -> DataFrame:
    """Column runs of a union: those that overlap or touch become one."""
    w = Window.partitionBy(*key, "x").orderBy("y0", "y1")
    end = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = columns.withColumn("_e", end).withColumn("_g", F.sum((F.col("_e").isNull() | (F.col("y0") > F.col("_e"))).cast("int")).over(w))
    return d.groupBy(*key, "x", "_g").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_g")


def _grown(columns: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Column runs dilated by a disc: a run goes to 2 * radius + 1 columns, longer by the disc's half column there. Heads (empty
    runs at 0) stay as they are."""
    disc = [F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(math.isqrt(radius * radius - dx * dx)).cast("bigint").alias("dy")) for dx in range(-radius, radius + 1)]
    head, dx, dy = F.col("y1") == 0, F.col("d.dx"), F.col("d.dy")
    d = columns.withColumn("d", F.explode(F.array(*disc))).filter((~head | (dx == 0)) & (F.col("x") + dx >= 0) & (F.col("x") + dx < F.col("width")))
    y0, y1 = F.greatest(F.lit(0).cast("bigint"), F.col("y0") - dy), F.least(F.col("height"), F.col("y1") + dy)
    return _merged(d.select(*key, (F.col("x") + dx).alias("x"), y0.alias("y0"), F.when(head, F.col("y1")).otherwise(y1).alias("y1")), key)


def _outside(columns: DataFrame, key: list[str]) -> DataFrame:
    """Column runs of what masks leave of their pictures, heads again among them: the gap after each run. A column's first run
    starts at 0, be it the head or a run that took it in."""
    after = F.coalesce(F.lead("y0").over(Window.partitionBy(*key, "x").orderBy("y0")), F.col("height"))
    run = lambda a, b: F.struct(a.alias("y0"), b.alias("y1"))
    gap, head = run(F.col("y1"), after), run(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    d = columns.select(*key, "x", F.when(F.col("y0") == 0, F.array(gap, head)).otherwise(F.array(gap)).alias("g"))
    d = d.select(*key, "x", F.explode("g").alias("g")).select(*key, "x", "g.y0", "g.y1")
    return _merged(d.filter("y0 < y1 or y1 = 0"), key)


def morph_columns(runs: DataFrame, key: list[str], steps: list[tuple[str, int]]) -> DataFrame:
    """(key, width, height, x, y0, y1): morph_runs() as column runs."""
    if bad := [s for s in steps if s[0] not in ("dilate", "erode") or s[1] < 0]:
        raise ValueError(f"steps are (dilate or erode, radius): {bad}")
    mask, zero = [*key, "width", "height"], F.lit(0).cast("bigint")
    sound = runs.withColumns({k: F.col(k).cast("bigint") for k in ("width", "height", "start", "length")}).filter("width > 0 and height > 0")
    start, end = F.greatest(zero, "start"), F.least(F.col("start") + F.col("length"), F.col("width") * F.col("height"))
    sound = sound.filter(F.col("start").isNotNull() & F.col("length").isNotNull()).select(*mask, start.alias("start"), (end - start).alias("length"))
    # every later grouping is by a mask and one of its columns, so this exchange, of runs, is the only one
    sound = sound.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *mask)
    # the run that comes first in a mask gives a head to each of its picture's columns, so that no mask and no column is forgotten
    first = F.row_number().over(Window.partitionBy(*mask).orderBy("start", "length")) == 1
    heads = F.when(first, F.transform(F.sequence(zero, F.col("width") - 1), lambda x: F.struct(x.alias("x"), zero.alias("y0"), zero.alias("y1"))))
    own = F.when(F.col("length") > 0, _columns(F.col("start"), F.col("length"), F.col("height")))
    none = F.array().cast("array<struct<x:bigint,y0:bigint,y1:bigint>>")
    d = sound.withColumn("r", F.concat(F.coalesce(own, none), F.coalesce(heads, none)))
    d = _merged(d.select(*mask, F.explode("r").alias("r")).select(*mask, "r.x", "r.y0", "r.y1"), mask)
    for step, radius in steps:
        d = _grown(d, mask, radius) if step == "dilate" else _outside(_grown(_outside(d, mask), mask, radius), mask)
    return d.filter("y0 < y1")


def morph_runs(runs: DataFrame, key: list[str], steps: list[tuple[str, int]]) -> DataFrame:
    """(key, width, height, start, length) after some steps ("dilate" or "erode", radius of a disc) on masks of runs.

    runs: key, width, height (a picture's own), start, length; they may overlap and repeat. No row is a pixel and no picture is
    held: dilation lengthens runs, erosion dilates what the mask leaves of its picture, so what lies outside a picture counts as
    mask there. What runs have outside a picture is cut off; pictures without sides, runs with nulls, and masks that are empty or
    worn away give no row.
    """
    d = morph_columns(runs, key, steps)
    mask = [*key, "width", "height"]
    return union_runs(d.select(*mask, (F.col("x") * F.col("height") + F.col("y0")).alias("start"), (F.col("y1") - F.col("y0")).alias("length")), mask)


def column_components(columns: DataFrame, key: str, stride: int = 1 << 16) -> DataFrame:
    """Column runs with their 8-neighbour component: runs of neighbouring columns that touch, by an equi-join on the column.

    key is one column of integers below 2^31, sides are below the stride; components are unique over all masks."""
    d = columns.withColumn("node", (F.col(key).cast("bigint") * stride + F.col("x")) * stride + F.col("y0"))
    left = d.select(key, (F.col("x") + 1).alias("x"), F.col("y0").alias("_u0"), F.col("y1").alias("_u1"), F.col("node").alias("_left"))
    edges = d.join(left, [key, "x"]).filter((F.col("y0") <= F.col("_u1")) & (F.col("_u0") <= F.col("y1")))
    found = components_within(edges.select(key, F.col("node").alias("a"), F.col("_left").alias("b")), key)
    return d.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select(*columns.columns, "component")


def clean_runs(runs: DataFrame, key: str, radius_open: int, radius_close: int, least: int) -> DataFrame:
    """(key, width, height, start, length): masks of runs opened, closed, and without components below `least` pixels."""
    steps = [("erode", radius_open), ("dilate", radius_open), ("dilate", radius_close), ("erode", radius_close)]
    parts = column_components(cut(morph_columns(runs, [key], steps)), key)  # runs and their edges both read the cut table
    w = Window.partitionBy(key, "component")
    kept = parts.withColumn("_n", F.sum(F.col("y1") - F.col("y0")).over(w)).filter(F.col("_n") >= least)
    places = kept.select(key, "width", "height", (F.col("x") * F.col("height") + F.col("y0")).alias("start"), (F.col("y1") - F.col("y0")).alias("length"))
    return union_runs(places, [key, "width", "height"])


def coco_counts(runs: Column, places: int) -> Column:
    """Sorted runs (array<struct<start, length>>) of a picture as COCO's counts: places outside and inside, in turn."""
    ends = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("counts")),
        lambda s, r: F.struct((r["start"] + r["length"]).cast("bigint").alias("at"), F.concat(s["counts"], F.array((r["start"] - s["at"]).cast("bigint"), r["length"].cast("bigint"))).alias("counts")),
    )
    return F.when(ends["at"] < places, F.concat(ends["counts"], F.array(F.lit(places) - ends["at"]))).otherwise(ends["counts"])


def run_overlap(predicted: DataFrame, target: DataFrame, key: list[str], samples: DataFrame | None = None) -> DataFrame:
    """(key, inter, union_) of two tables of masks (key, start, length): one sweep over the ends of both tables' runs.

    Runs may overlap and come in any order. A mask that only one table has meets an empty one; with samples (key) there is a
    row for each of them, also where both masks are empty (0 and 0).
    """
    ends = lambda d, a, b: d.select(*key, F.explode(F.array(
        F.struct(F.col("start").alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")),
        F.struct((F.col("start") + F.col("length")).alias("p"), F.lit(-a).alias("a"), F.lit(-b).alias("b")),
    )).alias("e")).select(*key, "e.*")
    w = Window.partitionBy(*key).orderBy("p")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends(predicted, 1, 0).unionByName(ends(target, 0, 1)).select(
        *key, (F.lead("p").over(w) - F.col("p")).alias("n"), (F.sum("a").over(upto) > 0).alias("a"), (F.sum("b").over(upto) > 0).alias("b")
    )
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("bigint")
    out = swept.groupBy(*key).agg(total(F.col("a") & F.col("b")).alias("inter"), total(F.col("a") | F.col("b")).alias("union_"))
    if samples is None:
        return out
    return samples.select(*key).join(out, key, "left").fillna(0, ["inter", "union_"])
