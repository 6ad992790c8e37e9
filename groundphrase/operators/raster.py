"""Pictures and masks as tables of pixels and runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.operators.graph import components_within
from groundphrase.operators.lineage import cut

CHANNELS = ("b", "g", "r")
#: Rows of the sepia matrix for b, g and r from b, g and r.
SEPIA = [[0.272, 0.534, 0.131], [0.349, 0.686, 0.168], [0.393, 0.769, 0.189]]
#: Hue classes of 0 to 179, the first that fits counts.
HUES = [("red", 0, 10), ("red", 170, 179), ("orange", 11, 20), ("yellow", 20, 34), ("green", 35, 85), ("cyan", 86, 100), ("blue", 101, 130), ("purple", 131, 145), ("magenta", 146, 169)]


def byte(x: Column) -> Column:
    """A value as a byte: cut to 0..255, then cut off; noise of the last digits is rounded away first."""
    return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)), 6)).cast("int")


def gray(b: str = "b", g: str = "g", r: str = "r") -> Column:
    """0.114 b + 0.587 g + 0.299 r in thousandths, so that halves are exact; they round up."""
    return F.floor((114 * F.col(b) + 587 * F.col(g) + 299 * F.col(r) + 500) / 1000).cast("int")


def contrast_gamma(pixels: DataFrame, contrast: float, gamma: float, value: str = "v") -> DataFrame:
    """Gamma, then contrast around the image's mean. The mean is aggregated and joined back, so images may be of any size."""
    d = pixels.withColumn("_p", F.pow(F.col(value) / 255.0, F.lit(gamma)) * 255.0)
    mean = d.groupBy("image_id").agg(F.avg("_p").alias("_m"))
    out = d.join(mean, "image_id")
    return out.withColumn("out", byte((F.col("_p") - F.col("_m")) * contrast + F.col("_m"))).drop("_p", "_m")


def sepia(pixels: DataFrame) -> DataFrame:
    total = lambda row: sum((k * F.col(c) for k, c in zip(row, CHANNELS, strict=True)), F.lit(0.0))
    out = {f"s_{c}": F.least(F.lit(255), F.floor(F.round(total(row) + 0.5, 6)).cast("int")) for c, row in zip(CHANNELS, SEPIA, strict=True)}
    return pixels.withColumns(out)


def _uniform(seed: int, *ids: str) -> Column:
    """A number in (0, 1) that depends on the seed and ids alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def film_grain(pixels: DataFrame, intensity: float = 0.1, seed: int = 1, value: str = "v", draws: tuple[Column, Column] | None = None) -> DataFrame:
    """Gaussian noise of 255 * intensity, the same for a pixel under any partitioning; draws: two numbers in (0, 1) of a
    pixel instead of hashes."""
    ids = ("image_id", "x", "y")
    one, two = draws or (_uniform(seed, *ids), _uniform(seed + 1, *ids))
    return pixels.withColumn("out", byte(F.col(value) + F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two) * 255 * intensity))


def uniform_noise(pixels: DataFrame, seed: int = 1, value: str = "v", top: int = 50, draw: Column | None = None) -> DataFrame:
    """Adds 0..top - 1, by a hash of the pixel or another whole number that is not negative."""
    number = F.xxhash64(F.lit(seed), "image_id", "x", "y") if draw is None else draw
    return pixels.withColumn("out", F.least(F.lit(255), F.col(value) + F.pmod(number, F.lit(top))).cast("int"))


def moments(pixels: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Mean and standard deviation of each image's channels."""
    return pixels.groupBy("image_id").agg(*[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("m", F.avg), ("s", F.stddev_pop))])


def first_of_domains(domains: DataFrame, most: int | None) -> DataFrame:
    """At most `most` images (image_id, domain) of a domain, in hashed order; None: all of them."""
    if most is None:
        return domains
    w = Window.partitionBy("domain").orderBy(F.xxhash64("image_id"), "image_id")
    return domains.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def averaged(m: DataFrame) -> DataFrame:
    """(domain, means, deviations, num_images) of images' moments with their domain."""
    return m.groupBy("domain").agg(*[F.avg(f"{n}_{c}").alias(f"{n}_{c}") for c in CHANNELS for n in "ms"], F.count("*").alias("num_images"))


def style_bank(pixels: DataFrame, domains: DataFrame, most: int | None = 500) -> DataFrame:
    """(domain, means, deviations, num_images): averages over at most `most` images of a domain, in hashed order; None: over all."""
    return averaged(moments(pixels).join(first_of_domains(domains, most), "image_id"))


def moment_transfer(pixels: DataFrame, bank: DataFrame, channels: tuple[str, ...] = CHANNELS, as_bytes: bool = True) -> DataFrame:
    """Channels t_* with the bank row's moments; bank has image_id and those it takes. A flat channel keeps its values."""
    own = moments(pixels, channels).select("image_id", *[F.col(f"{n}_{c}").alias(f"o{n}_{c}") for c in channels for n in "ms"])
    d = pixels.join(own.join(bank, "image_id"), "image_id")
    out = {}
    for c in channels:
        scaled = (F.col(c) - F.col(f"om_{c}")) / F.col(f"os_{c}") * F.col(f"s_{c}") + F.col(f"m_{c}")
        x = F.when(F.col(f"os_{c}") > 0, scaled).otherwise(F.col(c).cast("double"))
        out[f"t_{c}"] = byte(x) if as_bytes else x
    return d.select(*pixels.columns, *[v.alias(k) for k, v in out.items()])


def match_histogram(pixels: DataFrame, pairs: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, level, matched) of match_levels() for a table of pixels."""
    return match_levels(pixels.groupBy("image_id", F.col(value).alias("level")).agg(F.count("*").alias("n")), pairs)


def match_levels(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, level, matched): where each grey level of an image goes so that its distribution is that of another.

    counts has image_id, level, n; pairs image_id and target_id. Levels, at most 256 an image, meet levels; pixels do not."""
    w = Window.partitionBy("image_id")
    up = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    cdf = counts.select("image_id", "level", (F.sum("n").over(up) / F.sum("n").over(w)).alias("cdf"))
    before = F.coalesce(F.lag("cdf").over(w.orderBy("level")), F.lit(0.0))
    to = cdf.withColumn("before", before).select(F.col("image_id").alias("target_id"), F.col("level").alias("to"), F.col("cdf").alias("to_cdf"), "before")
    d = cdf.join(pairs, "image_id").join(to, "target_id").filter(F.col("to_cdf") > F.col("cdf"))
    found = d.groupBy("image_id", "level", "cdf").agg(F.min(F.struct("to", "to_cdf", "before")).alias("n"))
    x = F.when(F.col("n.to") == 0, 0).otherwise(F.col("n.to") - 1 + (F.col("cdf") - F.col("n.before")) / (F.col("n.to_cdf") - F.col("n.before")))
    return cdf.join(pairs, "image_id").join(found.withColumn("x", x).select("image_id", "level", "x"), ["image_id", "level"], "left").select(
        "image_id", "level", F.coalesce(byte(F.col("x").cast("double")), F.lit(255)).alias("matched")
    )


def vignette(pixels: DataFrame, width: int, height: int, strength: float = 0.3, value: str = "v") -> DataFrame:
    cx, cy = width // 2, height // 2
    far = math.sqrt(cx * cx + cy * cy)
    near = F.sqrt(F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)) / far
    return pixels.withColumn("out", byte(F.col(value) * F.greatest(F.lit(0.7), F.least(F.lit(1.0), 1 - near * strength))))


def to_hsv(pixels: DataFrame) -> DataFrame:
    """h (0..179), s, v as bytes."""
    b, g, r = (F.col(c).cast("double") for c in CHANNELS)
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    turn = F.when(d == 0, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    h = F.floor(F.when(turn < 0, turn + 360).otherwise(turn) / 2 + 0.5)
    s = F.when(v == 0, 0.0).otherwise(255 * d / v)
    return pixels.withColumns({"h": F.pmod(h, F.lit(180)).cast("int"), "s": F.floor(s + 0.5).cast("int"), "v": v.cast("int")})


def hue_class(h: Column) -> Column:
    out = None
    for name, low, high in HUES:
        on = h.between(low, high)
        out = F.when(on, name) if out is None else out.when(on, name)
    return out.otherwise("unknown")


def dominant_colour(pixels: DataFrame, key: list[str], least: int = 100) -> DataFrame:
    """(key, colour, is_ambiguous) of pixels with h, s, v: light, dark, a hue class, or null (ambiguous)."""
    grey = F.col("s") * 100 / 255 < 25
    light = grey & (F.col("v") * 100 / 255 >= 54)
    kinds = pixels.withColumn("_k", F.when(light, "light").when(grey, "dark").otherwise(hue_class(F.col("h"))))
    counts = kinds.groupBy(*key, "_k").agg(F.count("*").alias("n"))
    chromatic = F.when(~F.col("_k").isin("light", "dark"), F.col("n"))
    best = F.max(F.when(~F.col("_k").isin("light", "dark"), F.struct("n", "_k")))
    t = counts.groupBy(*key).agg(
        F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("_k") == "light", F.col("n"))), F.lit(0)).alias("l"),
        F.coalesce(F.sum(F.when(F.col("_k") == "dark", F.col("n"))), F.lit(0)).alias("d"), F.coalesce(F.sum(chromatic), F.lit(0)).alias("c"), best.alias("best"),
    )
    share = lambda *x: sum((F.col(i) for i in x), F.lit(0)) * 100 / F.col("t")
    colour = (
        F.when(F.col("t") < least, F.lit(None))
        .when(share("l") >= 70, "light").when(share("d") >= 70, "dark")
        .when((share("l", "c") >= 70) & (F.col("l") > F.col("d")) & (F.col("l") > F.col("c")), "light")
        .when((share("d", "c") >= 70) & (F.col("d") > F.col("l")) & (F.col("d") > F.col("c")), "dark")
        .when((share("c") >= 70) & (F.col("best.n") * 100 / F.col("c") >= 60), F.col("best._k"))
    )
    return t.withColumn("colour", colour).select(*key, "colour", F.col("colour").isNull().alias("is_ambiguous"))


def overlay(pixels: DataFrame, mask: DataFrame, alpha: float = 0.4, colour: tuple[int, int, int] = (0, 0, 255)) -> DataFrame:
    """Channels o_* with the mask's pixels (image_id, x, y) tinted."""
    d = pixels.join(mask.select("image_id", "x", "y").distinct().withColumn("_on", F.lit(True)), ["image_id", "x", "y"], "left")
    out = {f"o_{c}": F.when(F.col("_on"), byte((1 - alpha) * F.col(c) + alpha * v)).otherwise(F.col(c)) for c, v in zip(CHANNELS, colour, strict=True)}
    return d.withColumns(out).drop("_on")


def highlight(pixels: DataFrame, boxes: DataFrame, colour: tuple[int, int, int] = (0, 0, 255), thick: int = 2) -> DataFrame:
    """Channels o_* with the outlines of boxes (image_id, xmin, ymin, xmax, ymax; ends excluded) drawn inside them, `thick`
    pixels wide. The outline's pixels are made from the box and met by an equi-join."""
    span = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.col(hi) - 1))
    near = lambda p, lo, hi: (F.col(p) < F.col(lo) + thick) | (F.col(p) >= F.col(hi) - thick)
    cells = boxes.filter("xmin < xmax and ymin < ymax").withColumn("x", span("xmin", "xmax")).withColumn("y", span("ymin", "ymax"))
    return overlay(pixels, cells.filter(near("x", "xmin", "xmax") | near("y", "ymin", "ymax")), 1.0, colour)


def pack(pixels: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(image_id, width, height, data): pixels as rows of bytes, b, g, r in the layout of Spark's image source."""
    cell = F.struct("y", "x", F.concat(*[F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0") for c in channels]).alias("h"))
    out = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sort_array(F.collect_list(cell)).alias("p"))
    return out.select("image_id", "width", "height", F.unhex(F.concat_ws("", "p.h")).alias("data"))


def unpack(images: DataFrame) -> DataFrame:
    """Pixels of packed pictures. Bytes are taken by their place, so a pixel costs the same in any picture."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    d = images.select("image_id", "width", "data", at)
    value = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    return d.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
                    *[value(k).alias(c) for k, c in enumerate(CHANNELS)])


# ---- masks

def to_runs(mask: DataFrame, key: list[str], height: int) -> DataFrame:
    """(key, start, length): runs of column-major places of a mask's pixels; a pixel that repeats counts once."""
    p = mask.select(*key, (F.col("x") * height + F.col("y")).alias("p")).distinct()
    w = Window.partitionBy(*key).orderBy("p")
    return p.withColumn("_g", F.col("p") - F.row_number().over(w)).groupBy(*key, "_g").agg(F.min("p").alias("start"), F.count("*").alias("length")).drop("_g")


def from_runs(runs: DataFrame, key: list[str], height: int) -> DataFrame:
    p = runs.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p"))
    return p.select(*key, F.floor(F.col("p") / height).cast("int").alias("x"), (F.col("p") % height).cast("int").alias("y"))


def union_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """Runs of the union of masks: overlapping and touching runs become one."""
    w = Window.partitionBy(*key).orderBy("start", "length")
    end = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = runs.withColumn("_e", end).withColumn("_g", F.sum((F.col("_e").isNull() | (F.col("start") > F.col("_e"))).cast("int")).over(w))
    return d.groupBy(*key, "_g").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length")).drop("_g")


def mask_stats(mask: DataFrame, key: list[str], source_area: Column | None = None, share: float = 0.5, least: int = 500) -> DataFrame:
    """(key, area, box, is_cutoff): cut off if less than `share` of the source area and fewer than `least` pixels show."""
    out = mask.groupBy(*key).agg(F.count("*").alias("area"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"))
    if source_area is None:
        return out
    return out.withColumn("is_cutoff", (F.col("area") / source_area < share) & (F.col("area") < least))


#: Cuts of edges with rows that are held at a time, if a polygon has no more.
CUTS = 1 << 20


def _cuts(points: pa.Array, width: np.ndarray, height: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(polygon, y, x0, x1) of the polygons of a batch, by their places in it; some polygons at a time."""
    size = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = pc.cast(points.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    n, start = np.where(size >= 6, size // 2, 0), np.cumsum(size) - size
    poly = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(poly)) - np.repeat(np.cumsum(n) - n, n)
    p, q = start[poly] + 2 * k, start[poly] + 2 * np.where(k + 1 == n[poly], 0, k + 1)
    px, py, qx, qy = v[p], v[p + 1], v[q], v[q + 1]
    known = ~np.isnan(px + py + qx + qy)
    poly, px, py, qx, qy = (a[known] for a in (poly, px, py, qx, qy))
    first = np.maximum(0.0, np.floor(np.minimum(py, qy)))
    count = np.maximum(0.0, np.minimum(height[poly], np.ceil(np.maximum(py, qy))) - first).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(count)])
    last = np.append(np.flatnonzero(np.diff(poly)), len(poly) - 1) + 1 if len(poly) else []  # where polygons end
    at, ends = 0, []
    for i, end in enumerate(last):
        if i + 1 == len(last) or upto[last[i + 1]] - upto[at] > CUTS:
            ends.append((at, int(end)))
            at = int(end)
    for lo, hi in ends:
        e = lo + np.repeat(np.arange(hi - lo), count[lo:hi])
        y = first[e] + (np.arange(len(e)) + upto[lo] - upto[e])
        cy = y + 0.5
        on = (py[e] <= cy) != (qy[e] <= cy)
        e, y, cy = e[on], y[on], cy[on]
        x = px[e] + (cy - py[e]) * (qx[e] - px[e]) / (qy[e] - py[e])
        order = np.lexsort((x, y, poly[e]))
        of, y, x = poly[e][order], y[order], np.ceil(x[order] - 0.5)
        # a polygon is closed, so a row has an even number of cuts, unless an edge of unknown ends is left out
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (y[1:] != y[:-1])
        rank = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
        left = np.flatnonzero((rank[:-1] % 2 == 0) & ~new[1:])
        x0, x1 = np.maximum(0.0, x[left]), np.minimum(width[of[left]], x[left + 1])
        some = x0 < x1
        yield tuple(a[some] for a in (of[left], y[left], x0, x1))


def rasterize_runs(polygons: DataFrame) -> DataFrame:
    """(polygon_id, y, x0, x1): runs x0..x1 - 1 of pixels whose centres lie inside a polygon (even-odd rule), and which the
    image holds. Edges meet the rows that they cross, and the cuts of a row are paired in order. A row of the table is a polygon,
    whose cuts a task holds; nothing is exchanged.

    polygons: polygon_id, points (x0, y0, x1, y1, ...), width, height. A boundary rule of its own: a centre on an edge
    belongs to the pixel right of or below it. Fewer than three points give no pixels."""
    d = polygons.select("polygon_id", "points", "width", "height")
    long = d.schema["width"].dataType.simpleString() == "bigint"
    kinds = [pa.int32(), pa.int32(), pa.int64() if long else pa.int32()]

    def side(a: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.cast(a, pa.float64()), float("inf")).to_numpy(zero_copy_only=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, *cells in _cuts(batch.column(1), side(batch.column(2)), side(batch.column(3))):
                told = [pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cells, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *told], ["polygon_id", "y", "x0", "x1"])

    return d.mapInArrow(work, f"polygon_id {d.schema['polygon_id'].dataType.simpleString()}, y int, x0 int, x1 {'bigint' if long else 'int'}")


def rasterize(polygons: DataFrame) -> DataFrame:
    """(polygon_id, x, y) of rasterize_runs()."""
    return rasterize_runs(polygons).select("polygon_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y")


def shape_stats(mask: DataFrame, key: list[str]) -> DataFrame:
    """(key, area, aspect, solidity) of components' pixels: width by height of the box, and the area by that of the convex hull
    of the pixels' centres (0 for a hull without area). Hulls are made from the ends of a component's rows."""
    ends = mask.groupBy(*key, "y").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"))

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(float(x), float(y)) for y, a, b in zip(pdf["y"], pdf["x1"], pdf["x2"], strict=True) for x in (a, b)})
        chain: list[list] = []
        for side in (points, points[::-1]):
            out: list[tuple[float, float]] = []
            for p in side:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            chain.append(out[:-1])
        hull = chain[0] + chain[1]
        double = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
        area = int(pdf["n"].sum())
        width, height = pdf["x2"].max() - pdf["x1"].min() + 1, pdf["y"].max() - pdf["y"].min() + 1
        row = [pdf[k].iloc[0] for k in key] + [area, width / height, 2 * area / abs(double) if double else 0.0]
        return pd.DataFrame([row], columns=[*key, "area", "aspect", "solidity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.schema if f.name in key)
    return ends.groupBy(*key).applyInPandas(hulls, f"{kinds}, area long, aspect double, solidity double").select(*key, "area", "aspect", "solidity")


def _shifted(a: np.ndarray, dx: int, dy: int, fill: bool) -> np.ndarray:
    """a moved by (dx, dy); what comes in from outside is `fill`."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def _offsets(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def morph(mask: DataFrame, key: list[str], steps: list[tuple[str, int]], width: int, height: int) -> DataFrame:
    """(key, x, y) after some steps ("dilate" or "erode", radius of a disc), one shuffle by mask. A mask is a picture of width by
    height pixels, held as such; what lies outside it is passed over. Erosion counts what is outside the picture as mask."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros((height, width), bool)
        inside = pdf["x"].between(0, width - 1) & pdf["y"].between(0, height - 1)
        on[pdf["y"][inside], pdf["x"][inside]] = True
        for step, radius in steps:
            moved = [_shifted(on, dx, dy, step == "erode") for dx, dy in _offsets(radius)]
            on = np.logical_or.reduce(moved) if step == "dilate" else np.logical_and.reduce(moved)
        ys, xs = np.nonzero(on)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(xs) for k in key}, "x": xs, "y": ys})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.select(*key).schema)
    return mask.select(*key, "x", "y").groupBy(*key).applyInPandas(work, f"{kinds}, x int, y int")


def dilate(mask: DataFrame, key: list[str], radius: int, width: int, height: int) -> DataFrame:
    return morph(mask, key, [("dilate", radius)], width, height)


def erode(mask: DataFrame, key: list[str], radius: int, width: int, height: int) -> DataFrame:
    return morph(mask, key, [("erode", radius)], width, height)


def opening(mask: DataFrame, key: list[str], radius: int, width: int, height: int) -> DataFrame:
    return morph(mask, key, [("erode", radius), ("dilate", radius)], width, height)


def closing(mask: DataFrame, key: list[str], radius: int, width: int, height: int) -> DataFrame:
    return morph(mask, key, [("dilate", radius), ("erode", radius)], width, height)


def mask_components(mask: DataFrame, key: list[str], stride: int = 1 << 16) -> DataFrame:
    """(key, x, y, component): 8-neighbour components. Runs of rows, not pixels, are the graph's nodes.

    key is one column of integers (mask) below 2^31; components are unique over all masks."""
    (k,) = key
    w = Window.partitionBy(k, "y").orderBy("x")
    rows = mask.select(k, "x", "y").distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    runs = rows.groupBy(k, "y", "_g").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    runs = runs.withColumn("node", (F.col(k).cast("bigint") * stride + F.col("y")) * stride + F.col("x1"))
    up = runs.select(k, (F.col("y") + 1).alias("y"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("node").alias("up"))
    edges = runs.join(up, [k, "y"]).filter((F.col("x1") <= F.col("u2") + 1) & (F.col("u1") <= F.col("x2") + 1))
    found = components_within(edges.select(k, F.col("node").alias("a"), F.col("up").alias("b")), k)
    named = runs.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.select(k, F.explode(F.sequence("x1", "x2")).alias("x"), "y", "component")


def clean_mask(mask: DataFrame, key: str, radius_open: int, radius_close: int, least: int, width: int, height: int) -> DataFrame:
    """Opening, closing, and removal of components below `least` pixels."""
    steps = [("erode", radius_open), ("dilate", radius_open), ("dilate", radius_close), ("erode", radius_close)]
    m = cut(morph(mask, [key], steps, width, height))  # runs and their edges both read it
    parts = mask_components(m, [key])
    big = parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return parts.join(big.select("component"), "component", "left_semi").select(key, "x", "y")


def tile_resize(pixels: DataFrame, crop: int, size: int, value: str = "class_id") -> DataFrame:
    """(image_id, tile, x, y, value): 2 by 2 tiles of an image's first crop by crop pixels, enlarged by nearest pixels."""
    half = crop // 2
    tx, ty = F.floor(F.col("x") / half), F.floor(F.col("y") / half)
    cells = pixels.filter((F.col("x") < 2 * half) & (F.col("y") < 2 * half)).select(
        "image_id", (ty * 2 + tx).cast("int").alias("tile"), (F.col("x") % half).alias("sx"), (F.col("y") % half).alias("sy"), value
    )
    span = lambda s: F.explode(F.sequence(F.ceil(s * size / half), F.ceil((s + 1) * size / half) - 1))
    out = cells.filter(F.lit(size >= half)).withColumn("x", span(F.col("sx"))).withColumn("y", span(F.col("sy")))
    return out.select("image_id", "tile", F.col("x").cast("int"), F.col("y").cast("int"), value)


def style_distance(pixels: DataFrame, pairs: DataFrame, bins: int = 50) -> DataFrame:
    """(a, b, mean_distance, std_distance, histogram_distance) of pairs (a, b) of images."""
    cell = [F.floor(F.col(c) * bins / 256).alias(f"q_{c}") for c in CHANNELS]
    return distances(moments(pixels), pixels.groupBy("image_id", *cell).agg(F.count("*").alias("n")), pairs)


def distances(m: DataFrame, h: DataFrame, pairs: DataFrame) -> DataFrame:
    """style_distance() from images' moments and the counts n of their cells of colours (image_id, q_b, q_g, q_r)."""
    side = lambda x: m.select(F.col("image_id").alias(x), *[F.col(f"{n}_{c}").alias(f"{x}{n}_{c}") for c in CHANNELS for n in "ms"])
    norm = lambda n: F.sqrt(sum((F.pow(F.col(f"a{n}_{c}") - F.col(f"b{n}_{c}"), 2) for c in CHANNELS), F.lit(0.0)))
    dist = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", norm("m").alias("mean_distance"), norm("s").alias("std_distance"))
    total = h.groupBy("image_id").agg(F.sum("n").alias("t"))
    h = h.join(total, "image_id").withColumn("p", F.col("n") / F.col("t"))
    qs = [f"q_{c}" for c in CHANNELS]
    one = pairs.join(h.select(F.col("image_id").alias("a"), *qs, F.col("p").alias("pa")), "a")
    both = one.join(h.select(F.col("image_id").alias("b"), *qs, F.col("p").alias("pb")), ["b", *qs])
    common = both.groupBy("a", "b").agg(F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("_s"))
    out = dist.join(common, ["a", "b"], "left")
    return out.withColumn("histogram_distance", F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("_s", F.lit(0.0))))).drop("_s")


def landcover_groups(pixels: DataFrame, least: int = 1) -> DataFrame:
    """(image_id, class_id, area, centroid, box): all pixels of a class in a tile as one group."""
    return pixels.groupBy("image_id", "class_id").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("xmin"), F.min("y").alias("ymin"),
        (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"),
    ).filter(F.col("area") >= least)


def to_lab(pixels: DataFrame) -> DataFrame:
    """Columns l, a_, b_ (CIE L*a*b*, D65) of b, g, r bytes."""
    lin = lambda c: F.when(F.col(c) / 255 > 0.04045, F.pow((F.col(c) / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255 / 12.92)
    b, g, r = (lin(c) for c in CHANNELS)
    xyz = [(0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754]
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    fx, fy, fz = map(f, xyz)
    return pixels.withColumns({"l": 116 * fy - 16, "a_": 500 * (fx - fy), "b_": 200 * (fy - fz)})


def from_lab(pixels: DataFrame, l: str = "t_l", a: str = "t_a_", b: str = "t_b_") -> DataFrame:
    """Channels t_b, t_g, t_r from L*a*b* columns."""
    fy = (F.col(l) + 16) / 116
    back = lambda t: F.when(t > 0.206893, F.pow(t, F.lit(3))).otherwise((t - 16 / 116) / 7.787)
    x, y, z = back(fy + F.col(a) / 500) * 0.950456, back(fy), back(fy - F.col(b) / 200) * 1.088754
    rgb = {"t_r": 3.240479 * x - 1.53715 * y - 0.498535 * z, "t_g": -0.969256 * x + 1.875991 * y + 0.041556 * z, "t_b": 0.055648 * x - 0.204043 * y + 1.057311 * z}
    gam = lambda v: F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
    return pixels.withColumns({k: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), gam(v) * 255)) + 0.5).cast("int") for k, v in rgb.items()})


def moment_transfer_lab(pixels: DataFrame, bank: DataFrame) -> DataFrame:
    """Moment transfer in L*a*b*; bank has image_id and m_, s_ of l, a_ and b_."""
    t = moment_transfer(to_lab(pixels), bank, ("l", "a_", "b_"), as_bytes=False)
    return from_lab(t).select(*pixels.columns, "t_b", "t_g", "t_r")
