"""Windows over large pictures, and matches between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window_index(low: Column, high: Column, size: Column, patch: int, step: int) -> Column:
    """Indices of the windows along a side that overlap (low, high) strictly; empty if the side is too short."""
    last = F.floor((size - patch) / step)
    first = F.greatest(F.lit(0), F.floor((low - patch) / step) + 1)
    end = F.least(last, F.ceil(high / step) - 1)
    return F.when((size >= patch) & (first <= end), F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))


def image_windows(images: DataFrame, patch: int = 480, overlap: float = 0.2) -> DataFrame:
    """(image_id, ix, iy, x0, y0): all windows of pictures that are large enough."""
    step = max(1, int(patch * (1 - overlap)))
    span = lambda s: F.when(F.col(s) >= patch, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(s) - patch) / step))).otherwise(F.array().cast("array<bigint>"))
    d = images.select("image_id", F.explode(span("width")).alias("ix"), "height").select("image_id", "ix", F.explode(span("height")).alias("iy"))
    return d.select("image_id", "ix", "iy", (F.col("ix") * step).alias("x0"), (F.col("iy") * step).alias("y0"))


def assign_windows(images: DataFrame, boxes: DataFrame, patch: int = 480, overlap: float = 0.2, windows: DataFrame | None = None) -> DataFrame:
    """Boxes in each window that they overlap strictly, cut to it: an equi-join on (image, ix, iy), no cross product.

    windows may be a part of image_windows(), such as those that are not black. share is the part of the box inside."""
    step = max(1, int(patch * (1 - overlap)))
    sides = boxes.join(images.select("image_id", "width", "height"), "image_id")
    d = sides.withColumn("ix", F.explode(window_index(F.col("xmin"), F.col("xmax"), F.col("width"), patch, step)))
    d = d.withColumn("iy", F.explode(window_index(F.col("ymin"), F.col("ymax"), F.col("height"), patch, step))).drop("width", "height")
    w = image_windows(images, patch, overlap) if windows is None else windows
    d = d.join(w, ["image_id", "ix", "iy"])
    cut = lambda lo, hi, at: (F.greatest(F.col(lo) - F.col(at), F.lit(0)), F.least(F.col(hi) - F.col(at), F.lit(patch)))
    (x1, x2), (y1, y2) = cut("xmin", "xmax", "x0"), cut("ymin", "ymax", "y0")
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return d.withColumns({"left": x1, "right": x2, "top": y1, "bottom": y2, "share": (x2 - x1) * (y2 - y1) / area})


def patch_yield(images: DataFrame, boxes: DataFrame, patch: int = 480, overlap: float = 0.2, least: float = 0.5) -> DataFrame:
    """(image_id, possible, with_objects, without): windows, and those with a box at least half inside."""
    hit = assign_windows(images, boxes, patch, overlap).filter(F.col("share") >= least).select("image_id", "ix", "iy").distinct()
    hits = hit.groupBy("image_id").agg(F.count("*").alias("with_objects"))
    all_ = image_windows(images, patch, overlap).groupBy("image_id").agg(F.count("*").alias("possible"))
    out = all_.join(hits, "image_id", "left").withColumn("with_objects", F.coalesce("with_objects", F.lit(0)))
    return out.withColumn("without", F.col("possible") - F.col("with_objects"))


def orphan_images(images: DataFrame, annotations: DataFrame, on: str = "stem") -> DataFrame:
    return images.join(annotations.select(on).distinct(), on, "left_anti")


def pair_image_mask(images: DataFrame, masks: DataFrame, on: str = "id") -> DataFrame:
    return images.join(masks, on)


def match_descriptions(boxes: DataFrame, described: DataFrame, key: list[str], fallback: str = "the object in the image") -> DataFrame:
    """Boxes with the first description of the same place, or a fallback. described has key, pos and description."""
    w = Window.partitionBy(*key).orderBy("pos")
    first = described.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*key, "description")
    return boxes.join(first, key, "left").withColumn("description", F.coalesce("description", F.lit(fallback)))


def join_by_image(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Rows of left with the last row of right for their image."""
    last = right.groupBy(on).agg(F.max_by(F.struct(*[c for c in right.columns if c != on]), order).alias("_r"))
    return left.join(last, on).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in right.columns if c != on and c not in left.columns])


def resolve_annotations(refs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(ref_id, boxes): the annotations that a reference lists, in the order of the list; unknown ids are left out."""
    d = refs.select("ref_id", F.posexplode("ann_ids").alias("n", "ann_id")).join(annotations, "ann_id")
    cell = F.struct("n", "ann_id", "category", "xmin", "ymin", "xmax", "ymax")
    return d.groupBy("ref_id").agg(F.sort_array(F.collect_list(cell)).alias("boxes"))


def browse_refs(refs: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Sentences with their annotation's box and its category's name; the category table is small and left to the optimiser."""
    return refs.join(annotations, "ann_id").join(categories, "category_id").select("ref_id", "ann_id", "category_name", "sentence", "xmin", "ymin")


def add_missing_class_group(groups: DataFrame, class_pixels: DataFrame, name: str = "road") -> DataFrame:
    """groups (patch_id, group_id, category) and a group of this class where a patch has pixels of it but no group; its
    id follows the patch's greatest."""
    lacking = class_pixels.select("patch_id").distinct().join(groups.filter(F.col("category") == name), "patch_id", "left_anti")
    top = groups.groupBy("patch_id").agg(F.max("group_id").alias("_m"))
    new = lacking.join(top, "patch_id", "left").select("patch_id", (F.coalesce("_m", F.lit(-1)) + 1).alias("group_id"), F.lit(name).alias("category"))
    return groups.unionByName(new)


def samples(exprs: DataFrame, objects: DataFrame, groups: DataFrame | None = None, patch: str = "patch_id") -> DataFrame:
    """One row per target and phrase, with the target's class, box and mask (if objects have one). A group's box is that of
    its members (groups: patch, group_id, instance_ids, and category, mask, size, grid_position, centroid where known);
    without groups it has none."""
    box, key = ("xmin", "ymin", "xmax", "ymax"), [patch, "target_id"]
    more = lambda df, *names: [x for x in names if x in df.columns]
    own = objects.select(patch, F.col("object_id").alias("target_id"), "category", *box, *more(objects, "mask", "possible_colours", "grid_position"))
    one = exprs.filter("target_kind = 'individual'").join(own, key)
    several = exprs.filter("target_kind = 'group'")
    if groups is not None:
        inside = groups.select(patch, F.col("group_id").alias("target_id"), F.explode("instance_ids").alias("object_id"))
        ends = inside.join(objects.select(patch, "object_id", *box), [patch, "object_id"]).groupBy(*key).agg(
            *[f(c).alias(c) for c, f in zip(box, (F.min, F.min, F.max, F.max), strict=True)]
        )
        told = groups.withColumnRenamed("group_id", "target_id").select(*key, "instance_ids", *more(groups, "category", "mask", "size", "grid_position", "centroid"))
        several = several.join(told, key, "left").join(ends, key, "left")
    return one.unionByName(several, allowMissingColumns=True)


def described_boxes(docs: DataFrame, annotations: DataFrame, split: str, fallback: str = "the object in the image") -> DataFrame:
    """(image_id, bbox, segmentation, description): annotations of the split's images, described by the first object of the
    image's document with exactly this box and a description, else by the fallback.

    docs: image_id, split, object array<struct<bndbox, description>>; annotations: annotations array<struct<image_id, bbox
    (corners), segmentation array>>, of which the last of an image counts; the first mask of it is taken."""
    a = annotations.select(F.posexplode("annotations").alias("n", "a")).select("n", "a.*")
    last = a.groupBy("image_id").agg(F.max_by(F.struct("bbox", "segmentation"), "n").alias("a")).select("image_id", "a.*")
    d = docs.filter((F.col("split") == split) & F.col("image_id").isNotNull()).join(last, "image_id")
    corners = lambda o: F.array(*[o["bndbox"][x] for x in ("xmin", "ymin", "xmax", "ymax")])
    fits = F.filter("object", lambda o: (corners(o) == F.col("bbox")) & (F.coalesce(o["description"], F.lit("")) != ""))
    said = F.coalesce(F.get(fits, F.lit(0))["description"], F.lit(fallback))
    return d.select("image_id", "bbox", F.get("segmentation", F.lit(0)).alias("segmentation"), said.alias("description"))
