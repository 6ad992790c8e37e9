"""Pictures as blocks of whole rows of bytes: one row of a table for about a megabyte of pixels, not one for each pixel.

A table of blocks has image_id, width, height (the picture's), y0 (the block's first row), rows and data: rows * width * channels
bytes, row after row, the channels of a pixel side by side (b, g, r in colour pictures). What depends on a pixel's value alone is a
lookup table of 256 levels a channel, computed by column expressions from the levels that a picture has; what depends on its place
or on several channels is an Arrow kernel over batches of blocks. Statistics are counts of levels, added up in each block first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundphrase.operators import raster as ra

BLOCK = ["image_id", "width", "height", "y0", "rows"]
LIMIT = 1 << 20
#: A kernel takes the block's bytes as (rows, width, channels) and its row as a dict, and gives bytes of as many rows.
Kernel = Callable[[np.ndarray, dict], np.ndarray]


def to_blocks(images: DataFrame, channels: int = 3, limit: int = LIMIT) -> DataFrame:
    """Blocks of packed pictures (image_id, width, height, data): as many whole rows as fit in `limit` bytes, one at least.

    A picture without data, without pixels, or whose data is not width * height * channels bytes gives no block."""
    line = F.col("width").cast("bigint") * channels
    sound = images.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("data") == line * F.col("height")))
    d = sound.select("image_id", "width", "height", "data", F.greatest(F.lit(1), F.floor(limit / line)).cast("int").alias("_per"))
    d = d.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("_per"))))
    d = d.withColumn("rows", F.least(F.col("_per"), F.col("height") - F.col("y0")))
    size = F.col("width") * channels
    return d.select(*BLOCK, F.substring("data", F.col("y0") * size + 1, F.col("rows") * size).alias("data"))


def to_pictures(blocks: DataFrame) -> DataFrame:
    """(image_id, width, height, data): whole pictures again, for sinks that write a picture as one row."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("y0", "data"))), lambda p: p["data"])
    whole = F.when(F.size(parts) == 1, parts[0]).otherwise(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)))
    return blocks.groupBy("image_id", "width", "height").agg(whole.alias("data"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """A batch's rows one at a time, so that beside it no more than one block is held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data = np.frombuffer(row.pop("data"), np.uint8)
            yield row, data.reshape(row["rows"], row["width"], -1)


def map_blocks(blocks: DataFrame, kernel: Kernel) -> DataFrame:
    """Blocks with the kernel's bytes as data; further columns reach the kernel and are not kept."""
    out = blocks.select(*BLOCK, "data")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pixels in _each(batches):
            data = np.ascontiguousarray(kernel(pixels, row), np.uint8).tobytes()
            yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in BLOCK}, "data": data}], schema=_arrow(kinds_of))

    kinds_of = [(f.name, f.dataType.simpleString()) for f in out.schema]
    return blocks.mapInArrow(work, kinds)


def _arrow(kinds: list[tuple[str, str]]) -> pa.Schema:
    own = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, own[kind]) for name, kind in kinds])


def pixels_of(blocks: DataFrame, names: tuple[str, ...] = ra.CHANNELS) -> DataFrame:
    """(image_id, x, y, one int a channel) of blocks: for pixel tables, tests and reports."""
    key = [("image_id", blocks.schema["image_id"].dataType.simpleString())]
    kinds = [*key, ("x", "int"), ("y", "int"), *[(n, "int") for n in names]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(kinds)
        for row, p in _each(batches):
            y, x = np.divmod(np.arange(p.shape[0] * p.shape[1], dtype=np.int32), row["width"])
            flat = p.reshape(-1, p.shape[2]).astype(np.int32)
            ids = pa.array([row["image_id"]], schema.field(0).type).take(pa.array(np.zeros(len(x), np.int32)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(x), pa.array(y + row["y0"]), *[pa.array(flat[:, k]) for k in range(len(names))]], schema=schema)

    return blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))


def class_runs(blocks: DataFrame) -> DataFrame:
    """(image_id, class_id, width, height, start, length): the runs of each class in masks of one channel, whose levels are the
    classes; places are column-major. A block gives the runs of its own rows, and those that touch are then one."""
    key = [("image_id", blocks.schema["image_id"].dataType.simpleString())]
    kinds = [*key, ("class_id", "int"), ("width", "int"), ("height", "int"), ("start", "bigint"), ("length", "bigint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(kinds)
        for row, p in _each(batches):
            columns = np.ascontiguousarray(p[:, :, 0].T)  # x by y
            new = np.ones(columns.shape, bool)
            new[:, 1:] = columns[:, 1:] != columns[:, :-1]
            at = np.flatnonzero(new)
            x, y = np.divmod(at, row["rows"])
            same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(len(at), np.int32)))
            parts = [same(row["image_id"], schema.field(0).type), pa.array(columns.ravel()[at].astype(np.int32)), same(row["width"], pa.int32()), same(row["height"], pa.int32()),
                     pa.array(x * row["height"] + y + row["y0"]), pa.array(np.diff(at, append=columns.size))]
            yield pa.RecordBatch.from_arrays(parts, schema=schema)

    found = blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))
    return ra.union_runs(found, ["image_id", "class_id", "width", "height"])


# ---- statistics: counts of levels

def levels(blocks: DataFrame) -> DataFrame:
    """(image_id, channel, level, n): how many pixels of a picture have a level, 256 a channel at most."""
    kinds = [("image_id", blocks.schema["image_id"].dataType.simpleString()), ("channel", "int"), ("level", "int"), ("n", "bigint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, p in _each(batches):
            rows = []
            for k in range(p.shape[2]):
                counts = np.bincount(p[:, :, k].ravel(), minlength=256)
                rows += [{"image_id": row["image_id"], "channel": k, "level": int(v), "n": int(counts[v])} for v in np.nonzero(counts)[0]]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(kinds))

    part = blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))
    return part.groupBy("image_id", "channel", "level").agg(F.sum("n").alias("n"))


def moments(counts: DataFrame) -> DataFrame:
    """(image_id, m_b, s_b, ...): mean and deviation of each channel from counts of levels; sums are whole numbers, so exact."""
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("level")), F.sum(F.col("n") * F.col("level") * F.col("level"))
    one = counts.groupBy("image_id", "channel").agg(n.alias("t"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("t")
    # t q - s s is a whole number, held as a decimal: pictures of 10^9 pixels pass the range of 64 bits
    big = lambda c: F.col(c).cast("decimal(18,0)")
    spread = F.sqrt((big("t") * big("q") - big("s") * big("s")).cast("double")) / F.col("t")
    one = one.select("image_id", "channel", mean.alias("m"), spread.alias("d"))
    pick = lambda c, k: F.max(F.when(F.col("channel") == k, F.col(c)))
    return one.groupBy("image_id").agg(*[pick(c, k).alias(f"{n}_{ch}") for k, ch in enumerate(ra.CHANNELS) for n, c in (("m", "m"), ("s", "d"))])


# ---- lookup tables

def look_up(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with each level replaced by its picture's table (image_id, channel, level, out). Tables are gathered to one array a
    picture (at most 256 levels a channel); whether they are broadcast is the optimiser's choice by size."""
    cell = ((F.col("channel") * 256 + F.col("level")) * 256 + F.col("out")).cast("int")
    one = tables.groupBy("image_id").agg(F.collect_list(cell).alias("_t"))

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        to, cells = np.zeros((p.shape[2], 256), np.uint8), np.array(row["_t"])
        to.reshape(-1)[cells >> 8] = cells & 255
        return np.stack([to[k][p[:, :, k]] for k in range(p.shape[2])], axis=2)

    return map_blocks(blocks.join(one, "image_id"), kernel)


def contrast_gamma(blocks: DataFrame, contrast: float, gamma: float) -> DataFrame:
    """raster.contrast_gamma() of one-channel blocks: a table of levels from the picture's mean."""
    d = levels(blocks).withColumn("_p", F.pow(F.col("level") / 255.0, F.lit(gamma)) * 255.0)
    mean = d.groupBy("image_id").agg((F.sum(F.col("_p") * F.col("n")) / F.sum("n")).alias("_m"))
    return look_up(blocks, d.join(mean, "image_id").withColumn("out", ra.byte((F.col("_p") - F.col("_m")) * contrast + F.col("_m"))))


def moment_transfer(blocks: DataFrame, bank: DataFrame) -> DataFrame:
    """raster.moment_transfer() of colour blocks; pictures without a bank row (image_id, m_b, s_b, ...) give nothing."""
    counts = levels(blocks)
    own = moments(counts).select("image_id", *[F.col(f"{n}_{c}").alias(f"o{n}_{c}") for c in ra.CHANNELS for n in "ms"])
    d = counts.join(own.join(bank, "image_id"), "image_id")
    out = None
    for k, c in enumerate(ra.CHANNELS):
        scaled = (F.col("level") - F.col(f"om_{c}")) / F.col(f"os_{c}") * F.col(f"s_{c}") + F.col(f"m_{c}")
        x = F.when(F.col(f"os_{c}") > 0, ra.byte(scaled)).otherwise(F.col("level"))
        out = F.when(F.col("channel") == k, x) if out is None else out.when(F.col("channel") == k, x)
    return look_up(blocks, d.withColumn("out", out))


def style_bank(blocks: DataFrame, domains: DataFrame, most: int | None = 500) -> DataFrame:
    """raster.style_bank() from counts of levels. The pictures of a domain are chosen before their bytes are read."""
    chosen = ra.first_of_domains(domains, most)
    if most is not None:
        blocks = blocks.join(chosen.select("image_id"), "image_id", "left_semi")
    return ra.averaged(moments(levels(blocks)).join(chosen, "image_id"))


def match_histogram(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One-channel blocks of pictures with a target, their distribution matched to that of it (raster.match_levels())."""
    matched = ra.match_levels(levels(blocks).drop("channel"), pairs)
    return look_up(blocks, matched.select("image_id", F.lit(0).alias("channel"), "level", F.col("matched").alias("out")))


# ---- kernels

def _bytes(x: np.ndarray) -> np.ndarray:
    """raster.byte() of an array."""
    return np.floor(np.round(np.clip(x, 0.0, 255.0), 6)).astype(np.uint8)


def _places(p: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a block's pixels, to be broadcast against each other."""
    return np.arange(p.shape[1], dtype=np.int64)[None, :], np.arange(row["y0"], row["y0"] + p.shape[0], dtype=np.int64)[:, None]


def gray(blocks: DataFrame) -> DataFrame:
    """One channel: raster.gray() of b, g, r."""

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        b, g, r = (p[:, :, k].astype(np.int32) for k in range(3))
        return (114 * b + 587 * g + 299 * r + 500) // 1000

    return map_blocks(blocks, kernel)


def sepia(blocks: DataFrame) -> DataFrame:
    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        b, g, r = (p[:, :, k].astype(np.float64) for k in range(3))
        return np.stack([np.minimum(255, np.floor(np.round(x * b + y * g + z * r + 0.5, 6))) for x, y, z in ra.SEPIA], axis=2)

    return map_blocks(blocks, kernel)


def mixed(seed: int, image: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 63-bit number of a pixel that depends on seed, picture and place alone, so the same in any block."""
    with np.errstate(over="ignore"):
        h = np.uint64(image & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for part in (x.astype(np.uint64), y.astype(np.uint64)):
            h = (h ^ part) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(1)).astype(np.int64)


Draw = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def film_grain(blocks: DataFrame, intensity: float = 0.1, seed: int = 1, draws: tuple[Draw, Draw] | None = None) -> DataFrame:
    """Gaussian noise of 255 * intensity on one-channel blocks; draws: two numbers in (0, 1) of (image_id, x, y). Without
    them image_id must be a whole number."""
    uniform = lambda k: lambda i, x, y: ((mixed(seed + k, i, x, y) % (1 << 30)) + 0.5) / float(1 << 30)
    one, two = draws or (uniform(0), uniform(1))

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        x, y = _places(p, row)
        noise = np.sqrt(-2 * np.log(one(row["image_id"], x, y))) * np.cos(2 * math.pi * two(row["image_id"], x, y))
        return _bytes(p[:, :, 0] + noise * 255 * intensity)

    return map_blocks(blocks, kernel)


def uniform_noise(blocks: DataFrame, seed: int = 1, top: int = 50, draw: Draw | None = None) -> DataFrame:
    """Adds 0..top - 1 to one-channel blocks, saturated."""
    number = draw or (lambda i, x, y: mixed(seed, i, x, y))

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        x, y = _places(p, row)
        return np.minimum(255, p[:, :, 0].astype(np.int64) + number(row["image_id"], x, y) % top)

    return map_blocks(blocks, kernel)


def vignette(blocks: DataFrame, strength: float = 0.3, size: tuple[int, int] | None = None) -> DataFrame:
    """One-channel blocks darkened away from the middle of each picture, of its own size or of one given for all."""

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        x, y = _places(p, row)
        width, height = size or (row["width"], row["height"])
        cx, cy = width // 2, height // 2
        far = math.sqrt(cx * cx + cy * cy) or 1.0  # a picture of one pixel is its own middle
        near = np.sqrt((x - cx).astype(np.float64) ** 2 + (y - cy).astype(np.float64) ** 2) / far
        return _bytes(p[:, :, 0] * np.maximum(0.7, np.minimum(1.0, 1 - near * strength)))

    return map_blocks(blocks, kernel)


def to_hsv(blocks: DataFrame) -> DataFrame:
    """Blocks of h (0..179), s, v of b, g, r."""

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        b, g, r = (p[:, :, k].astype(np.float64) for k in range(3))
        v = np.maximum(np.maximum(b, g), r)
        d = v - np.minimum(np.minimum(b, g), r)
        by = np.where(d == 0, 1.0, d)
        turn = np.where(d == 0, 0.0, np.where(v == r, 60 * (g - b) / by, np.where(v == g, 120 + 60 * (b - r) / by, 240 + 60 * (r - g) / by)))
        h = np.floor(np.where(turn < 0, turn + 360, turn) / 2 + 0.5) % 180
        s = np.floor(np.where(v == 0, 0.0, 255 * d / np.where(v == 0, 1.0, v)) + 0.5)
        return np.stack([h, s, v], axis=2)

    return map_blocks(blocks, kernel)


def overlay(blocks: DataFrame, runs: DataFrame, alpha: float = 0.4, colour: tuple[int, int, int] = (0, 0, 255)) -> DataFrame:
    """Blocks with the pixels of runs (image_id, y, x0, x1; x1 excluded) tinted, each once. Runs outside a picture are passed over;
    runs meet the blocks' places first, so bytes move once, with the runs of their own block."""
    at = blocks.select("image_id", "width", "y0", "rows")
    cut = runs.join(at, "image_id").filter((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("rows")))
    cut = cut.select("image_id", "y0", F.struct(F.col("y").cast("int").alias("y"), F.greatest(F.lit(0), "x0").cast("int").alias("x0"), F.least("width", "x1").cast("int").alias("x1")).alias("r"))
    own = cut.filter("r.x0 < r.x1").groupBy("image_id", "y0").agg(F.collect_set("r").alias("_r"))
    tint = np.array(colour, np.float64)

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        if not row["_r"]:
            return p
        on = np.zeros(p.shape[:2], bool)
        for r in row["_r"]:
            on[r["y"] - row["y0"], r["x0"] : r["x1"]] = True
        return np.where(on[:, :, None], _bytes((1 - alpha) * p + alpha * tint), p)

    return map_blocks(blocks.join(own, ["image_id", "y0"], "left"), kernel)


def highlight(blocks: DataFrame, boxes: DataFrame, colour: tuple[int, int, int] = (0, 0, 255), thick: int = 2) -> DataFrame:
    """Blocks with the outlines of boxes (image_id, xmin, ymin, xmax, ymax; ends excluded) drawn inside them as runs."""
    d = boxes.filter("xmin < xmax and ymin < ymax").withColumn("y", F.explode(F.sequence("ymin", F.col("ymax") - 1)))
    edge = (F.col("y") < F.col("ymin") + thick) | (F.col("y") >= F.col("ymax") - thick)
    run = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    left, right = F.least("xmax", F.col("xmin") + thick), F.greatest("xmin", F.col("xmax") - thick)
    sides = F.when(edge, F.array(run(F.col("xmin"), F.col("xmax")))).otherwise(F.array(run(F.col("xmin"), left), run(right, F.col("xmax"))))
    return overlay(blocks, d.select("image_id", "y", F.explode(sides).alias("r")).select("image_id", "y", "r.*"), 1.0, colour)


def _linear(p: np.ndarray) -> np.ndarray:
    v = p / 255.0
    return np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)


def _lab(p: np.ndarray) -> np.ndarray:
    """(rows, width, 3) of L, a, b of b, g, r bytes; constants as in raster.to_lab()."""
    b, g, r = (_linear(p[:, :, k].astype(np.float64)) for k in range(3))
    xyz = ((0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754)
    fx, fy, fz = (np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116) for t in xyz)
    return np.stack([116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)], axis=2)


LAB = ("l", "a_", "b_")


def lab_moments(blocks: DataFrame) -> DataFrame:
    """(image_id, m_l, s_l, ...): means and deviations in L*a*b*. A block gives its count, means and squared deviations, which are
    put together around the picture's mean, so that nearly flat channels keep their digits."""
    kinds = [("image_id", blocks.schema["image_id"].dataType.simpleString()), ("n", "bigint"), *[(f"{a}_{c}", "double") for c in LAB for a in "mq"]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, p in _each(batches):
            flat = _lab(p).reshape(-1, 3)
            mean, out = flat.mean(axis=0), {"image_id": row["image_id"], "n": len(flat)}
            for k, c in enumerate(LAB):
                out |= {f"m_{c}": float(mean[k]), f"q_{c}": float(((flat[:, k] - mean[k]) ** 2).sum())}
            yield pa.RecordBatch.from_pylist([out], schema=_arrow(kinds))

    d = blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))
    n = F.col("n")
    one = d.groupBy("image_id").agg(F.collect_list(F.struct("n", *[f"{a}_{c}" for c in LAB for a in "mq"])).alias("p"), F.sum(n).alias("t"), *[(F.sum(n * F.col(f"m_{c}")) / F.sum(n)).alias(f"m_{c}") for c in LAB])
    add = lambda c: F.aggregate("p", F.lit(0.0), lambda a, r: a + r[f"q_{c}"] + r["n"] * (r[f"m_{c}"] - F.col(f"m_{c}")) * (r[f"m_{c}"] - F.col(f"m_{c}")))
    return one.select("image_id", *[x for c in LAB for x in (F.col(f"m_{c}"), F.sqrt(add(c) / F.col("t")).alias(f"s_{c}"))])


def moment_transfer_lab(blocks: DataFrame, bank: DataFrame) -> DataFrame:
    """raster.moment_transfer_lab() of colour blocks; bank has image_id and m_, s_ of l, a_ and b_."""
    names = [f"{n}_{c}" for n in "ms" for c in LAB]
    own = lab_moments(blocks).select("image_id", *[F.col(c).alias(f"o{c}") for c in names])

    def kernel(p: np.ndarray, row: dict) -> np.ndarray:
        lab = _lab(p)
        for k, c in enumerate(LAB):
            if row[f"os_{c}"] > 0:
                lab[:, :, k] = (lab[:, :, k] - row[f"om_{c}"]) / row[f"os_{c}"] * row[f"s_{c}"] + row[f"m_{c}"]
        fy = (lab[:, :, 0] + 16) / 116
        x, y, z = (np.where(t > 0.206893, t**3, (t - 16 / 116) / 7.787) for t in (fy + lab[:, :, 1] / 500, fy, fy - lab[:, :, 2] / 200))
        x, z = x * 0.950456, z * 1.088754
        bgr = (0.055648 * x - 0.204043 * y + 1.057311 * z, -0.969256 * x + 1.875991 * y + 0.041556 * z, 3.240479 * x - 1.53715 * y - 0.498535 * z)
        gam = [np.where(v > 0.0031308, 1.055 * np.maximum(v, 0.0) ** (1 / 2.4) - 0.055, 12.92 * v) for v in bgr]
        return np.stack([np.floor(np.round(np.clip(v * 255, 0, 255) + 0.5, 6)) for v in gam], axis=2)

    return map_blocks(blocks.join(own.join(bank.select("image_id", *names), "image_id"), "image_id"), kernel)


def tile_resize(blocks: DataFrame, crop: int, size: int) -> DataFrame:
    """Blocks with one more column, tile (0..3): 2 by 2 tiles of a picture's first crop by crop pixels, enlarged by nearest pixels to
    size by size. A block gives the rows of the tiles that it covers; what a smaller picture lacks is left out as rows, and
    zero to the right. Sizes below half the crop give nothing."""
    half = crop // 2
    kinds = [(f.name, f.dataType.simpleString()) for f in blocks.select(*BLOCK, "data").schema] + [("tile", "int")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, p in _each(batches):
            from_x = np.arange(size) * half // size  # the source of each column; likewise of each row
            for ty in (0, 1) if size >= half else ():
                ys = ty * half + from_x - row["y0"]
                mine = np.nonzero((ys >= 0) & (ys < p.shape[0]))[0]
                for tx in (0, 1) if len(mine) else ():
                    xs = tx * half + from_x
                    inside = xs < p.shape[1]
                    out = np.zeros((len(mine), size, p.shape[2]), np.uint8)
                    out[:, inside] = p[ys[mine]][:, xs[inside]]
                    cell = {"image_id": row["image_id"], "width": size, "height": size, "y0": int(mine[0]), "rows": len(mine), "data": out.tobytes(), "tile": 2 * ty + tx}
                    if inside.any():
                        yield pa.RecordBatch.from_pylist([cell], schema=_arrow(kinds))

    return blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))


def style_distance(blocks: DataFrame, pairs: DataFrame, bins: int = 50) -> DataFrame:
    """raster.style_distance() from blocks: a block gives the counts of its cells of colours, not its pixels."""
    kinds = [("image_id", blocks.schema["image_id"].dataType.simpleString()), *[(f"q_{c}", "int") for c in ra.CHANNELS], ("n", "bigint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, p in _each(batches):
            q = p.astype(np.int64) * bins // 256
            cells, n = np.unique((q[:, :, 0] * bins + q[:, :, 1]) * bins + q[:, :, 2], return_counts=True)
            cols = [cells // (bins * bins), cells // bins % bins, cells % bins]
            ids = pa.array([row["image_id"]] * len(cells), _arrow(kinds).field(0).type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int32)) for c in cols], pa.array(n.astype(np.int64))], schema=_arrow(kinds))

    part = blocks.select(*BLOCK, "data").mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in kinds))
    cells = part.groupBy("image_id", *[f"q_{c}" for c in ra.CHANNELS]).agg(F.sum("n").alias("n"))
    return ra.distances(moments(levels(blocks)), cells, pairs)


def too_black(blocks: DataFrame, share: Column | float = 0.5, dark: int = 10) -> DataFrame:
    """(image_id) of pictures of which more than `share` of the grey pixels are below `dark`."""
    n = levels(gray(blocks)).groupBy("image_id").agg((F.sum(F.when(F.col("level") < dark, F.col("n")).otherwise(0)) / F.sum("n")).alias("s"))
    return n.filter(F.col("s") > share).select("image_id")
