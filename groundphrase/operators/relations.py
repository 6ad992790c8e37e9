"""Relations, extremes, sizes and groups of a patch's objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.functions import geometry as g
from groundphrase.operators.graph import components_within
from groundphrase.operators.lineage import cut
from groundphrase.operators.proximity import cell_join, side


def self_pairs(df: DataFrame, key: list[str], on: Column) -> DataFrame:
    """Pairs (a_*, b_*) of rows with equal keys that meet a condition: an equi-join with a residual."""
    return side(df, "a_", key).join(side(df, "b_", key), key).filter(on)


def near_enough(base: float) -> Column:
    """Whether two objects (a_, b_ with geometry) are near enough for their size, and neither is in the other."""
    c = F.col
    reach = base + (c("a_width") + c("a_height")) / 4 + (c("b_width") + c("b_height")) / 4
    return (c("a_object_id") != c("b_object_id")) & (distance() <= reach) & ~g.contained("a_", "b_")


def distance() -> Column:
    """Between the centres of two objects (a_, b_)."""
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    return F.sqrt(dx * dx + dy * dy)


def _reach(base: float) -> Column:
    """How far near_enough() may hold from the larger one of two objects."""
    return base + (F.col("width") + F.col("height")) / 2


_BOX = ("xmin", "ymin", "xmax", "ymax", "cx", "cy", "width", "height")


def with_directions(pairs: DataFrame, sectors: str = "reference") -> DataFrame:
    """pairs (a_*, b_*) with is_borderline, direction, second. The angle is a column of its own: it is computed once."""
    told = pairs.withColumn("_angle", g.angle(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")))
    border, first, second = g.directions(F.col("_angle"), sectors)
    return told.withColumns({"is_borderline": border, "direction": first, "second": second}).drop("_angle")


def relate(objects: DataFrame, base: float = 150.0, sectors: str = "reference") -> DataFrame:
    """(patch_id, object_id, target_id, category, target_category, direction, distance, target_cutoff, is_borderline,
    possible_directions): one row per ordered pair of a patch that is near enough and not contained, and per possible
    direction if the angle is near a sector's edge."""
    o = g.with_geometry(objects).select("patch_id", "object_id", "category", *_BOX, "is_cutoff")
    c = F.col
    pairs = with_directions(cell_join(o, o, ["patch_id"], _reach(base), 2 * base, near_enough(base)), sectors)
    # never empty: "outer" keeps the optimiser from testing that on every pair of the join
    possible = F.array_compact(F.array("direction", "second"))
    return pairs.withColumns({"distance": distance(), "possible_directions": possible}).select(
        "patch_id", c("a_object_id").alias("object_id"), c("b_object_id").alias("target_id"),
        c("a_category").alias("category"), c("b_category").alias("target_category"),
        F.explode_outer("possible_directions").alias("direction"), "distance", c("b_is_cutoff").alias("target_cutoff"),
        "is_borderline", "possible_directions",
    )


def rank_relations(relations: DataFrame) -> DataFrame:
    """Relations numbered by distance for each object; ties by target and direction."""
    order = Window.partitionBy("patch_id", "object_id").orderBy("distance", "target_id", "direction")
    return relations.withColumn("rank", F.row_number().over(order))


def near_pairs(objects: DataFrame, eps: float = 40.0) -> DataFrame:
    """(patch_id, category, a, b, gap): objects of one class whose boxes are at most eps apart, a < b; cut-off ones out."""
    o = g.with_geometry(objects.filter(~F.col("is_cutoff"))).select("patch_id", "category", "object_id", *_BOX)
    gap = g.box_gap("a_", "b_")
    reach = eps + F.greatest("width", "height")
    pairs = cell_join(o, o, ["patch_id", "category"], reach, 2 * eps, (F.col("a_object_id") < F.col("b_object_id")) & (gap <= eps))
    return pairs.select("patch_id", "category", F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"), gap.alias("gap"))


def containment_pairs(objects: DataFrame) -> DataFrame:
    """(patch_id, object_id, target_id) of ordered pairs where a box or centroid is inside the other's box."""
    o = g.with_geometry(objects)
    pairs = self_pairs(o, ["patch_id"], (F.col("a_object_id") != F.col("b_object_id")) & g.contained("a_", "b_"))
    return pairs.select("patch_id", F.col("a_object_id").alias("object_id"), F.col("b_object_id").alias("target_id"))


def clusters(objects: DataFrame, eps: float = 40.0, min_samples: int = 2, max_samples: int = 8) -> DataFrame:
    """(patch_id, category, object_id, component): density clusters of boxes; component is the least core object's id.

    A point is core if it has min_samples points, itself included, within eps. Core points that are near each other
    share a cluster; a border point joins that of its least core neighbour. Clusters of more than max_samples dissolve.
    object_id must be unique over all patches. Clusters lie inside patches, so each task solves whole patches.
    """
    pairs = near_pairs(objects, eps)
    key = ["patch_id", "category"]
    of = lambda links: components_within(links, "patch_id", carry=tuple(key)).withColumnRenamed("node", "object_id")
    fits = F.col("size").between(min(2, min_samples), max_samples)
    if min_samples <= 2:  # whoever has a neighbour is core
        return of(pairs).filter(fits).select(*key, "object_id", "component")
    both = pairs.select(*key, "a", "b").unionByName(pairs.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy(*key, "a").count().filter(F.col("count") >= min_samples - 1).select(*key, F.col("a").alias("object_id"))
    inner = pairs.join(core.withColumnRenamed("object_id", "a"), [*key, "a"]).join(core.withColumnRenamed("object_id", "b"), [*key, "b"])
    cores = core.join(of(inner), [*key, "object_id"], "left").select(*key, "object_id", F.coalesce("component", "object_id").alias("component"))
    border = both.join(cores.withColumnRenamed("object_id", "b"), [*key, "b"]).join(core.withColumnRenamed("object_id", "a"), [*key, "a"], "left_anti")
    found = cores.unionByName(border.groupBy(*key, F.col("a").alias("object_id")).agg(F.min_by("component", "b").alias("component")))
    return found.withColumn("size", F.count("*").over(Window.partitionBy(*key, "component"))).filter(fits).drop("size")


def with_clusters(objects: DataFrame, members: DataFrame) -> DataFrame:
    """objects with component (null outside clusters), dealt by patch: marks are added to the rows instead of joined, so one
    exchange by patch serves all that follows."""
    marks = members.select("patch_id", "object_id", "component").withColumn("_mark", F.lit(True))
    every = objects.withColumns({"component": F.lit(None).cast("bigint"), "_mark": F.lit(False)}).unionByName(marks, allowMissingColumns=True)
    found = F.max("component").over(Window.partitionBy("patch_id", "object_id"))
    return every.repartition("patch_id").withColumn("component", found).filter("not _mark").drop("_mark")


def _cluster_number(inside: Column) -> Column:
    """1000 * (class order + 1) + label of rows with_clusters() that meet a condition; classes are ordered by their first object that
    is not cut off, labels by a cluster's first member (pos)."""
    of_class = Window.partitionBy("patch_id", "category")
    return F.when(inside, (F.col("_class") * 1000 + F.dense_rank().over(of_class.orderBy(F.col("_start").asc_nulls_last())) - 1).cast("bigint"))


def _ordered(tagged: DataFrame) -> DataFrame:
    """tagged with _class (order of the class in the patch, from 1) and _start (first pos of the row's cluster)."""
    first = F.min(F.when(~F.col("is_cutoff"), F.col("pos"))).over(Window.partitionBy("patch_id", "category"))
    start = F.when(F.col("component").isNotNull(), F.min("pos").over(Window.partitionBy("patch_id", "component")))
    d = tagged.withColumns({"_first": first, "_start": start})
    return d.withColumn("_class", F.dense_rank().over(Window.partitionBy("patch_id").orderBy(F.col("_first").asc_nulls_last())))


def number_clusters(objects: DataFrame, members: DataFrame) -> DataFrame:
    """(patch_id, category, object_id, group_id): 1000 * (class order + 1) + label.

    Classes are ordered by their first object that is not cut off, labels by a cluster's first member (pos)."""
    d = _ordered(with_clusters(objects, members))
    numbered = d.withColumn("group_id", _cluster_number(F.col("component").isNotNull()))
    return numbered.filter("component is not null").select("patch_id", "category", "object_id", "group_id")


def unassigned(objects: DataFrame, members: DataFrame) -> DataFrame:
    """Objects that are not cut off and in no cluster."""
    return with_clusters(objects, members).filter("not is_cutoff and component is null").drop("component")


def _near_clusters(tagged: DataFrame, base: float) -> DataFrame:
    """(patch_id, object_id), perhaps repeated: objects in no cluster that are near enough to a member of one."""
    o = g.with_geometry(tagged).select("patch_id", "object_id", *_BOX, "is_cutoff", "component")
    alone, inside = o.filter("not is_cutoff and component is null"), o.filter("component is not null")
    hits = cell_join(alone, inside, ["patch_id"], _reach(base), 2 * base, near_enough(base))
    return hits.select("patch_id", F.col("a_object_id").alias("object_id"))


def singles_near_clusters(objects: DataFrame, members: DataFrame, base: float = 150.0) -> DataFrame:
    """Unassigned objects that are near enough to a member of a cluster to be related to it."""
    tagged = cut(with_clusters(objects, members))
    return tagged.drop("component").join(_near_clusters(tagged, base), ["patch_id", "object_id"], "left_semi").select(*objects.columns)


def group_rows(objects: DataFrame, members: DataFrame, base: float = 150.0, small: str = "Small_Vehicle", large: str = "Large_Vehicle") -> DataFrame:
    """objects with group_id and group_category, a row for each group that an object is in, dealt by patch.

    Groups are the clusters, above them single objects that are near one (number 1000 * class order + 500000 + the number of
    the patch's groups before it), classes with more than one object (from 1000000 on, in the order of their first object),
    and both vehicle classes of a patch together (2000000). All kinds are windows over the same patch, so objects and the
    marks on them are dealt by patch once, and what follows by patch and group needs no exchange.
    """
    tagged = cut(with_clusters(objects, members))
    near = _near_clusters(tagged, base).withColumn("_near", F.lit(True))
    every = tagged.withColumn("_near", F.lit(False)).unionByName(near, allowMissingColumns=True).repartition("patch_id")
    marked = F.max("_near").over(Window.partitionBy("patch_id", "object_id"))
    d = every.withColumn("_single", marked).filter("not _near")
    patch, of_class = Window.partitionBy("patch_id"), Window.partitionBy("patch_id", "category")
    inside = F.col("component").isNotNull()
    d = _ordered(d).withColumns({
        "_cluster": _cluster_number(inside), "_n": F.count("*").over(of_class), "_head": F.min("pos").over(of_class),
        "_nth": F.row_number().over(patch.orderBy(F.col("_single").desc(), "pos")), "_before": F.size(F.collect_set("component").over(patch)),
        "_pair": (F.count_if(F.col("category") == small).over(patch) > 0) & (F.count_if(F.col("category") == large).over(patch) > 0),
    })
    many = F.dense_rank().over(patch.orderBy(F.when(F.col("_n") > 1, F.col("_head")).asc_nulls_last())) - 1
    alone = F.when(F.col("_single"), (F.col("_class") * 1000 + 500_000 + F.col("_nth") - 1 + F.col("_before")).cast("bigint"))
    row = lambda number, name: F.struct(number.cast("bigint").alias("group_id"), name.alias("group_category"))
    groups = F.array(
        row(F.coalesce("_cluster", alone), F.col("category")), row(F.when(F.col("_n") > 1, 1_000_000 + many), F.col("category")),
        row(F.when(F.col("_pair") & F.col("category").isin(small, large), 2_000_000), F.lit("vehicle_pair")),
    )
    told = d.withColumn("_groups", groups).select(*objects.columns, F.explode(F.filter("_groups", lambda x: x["group_id"].isNotNull())).alias("_g"))
    return told.select(*objects.columns, "_g.group_id", "_g.group_category")


def groups_of(rows: DataFrame) -> DataFrame:
    """(patch_id, group_id, category, instance_ids) of group_rows(); ids in the order of pos."""
    found = rows.groupBy("patch_id", "group_id").agg(F.max("group_category").alias("category"), F.sort_array(F.collect_list(F.struct("pos", "object_id"))).alias("m"))
    return found.select("patch_id", "group_id", "category", F.col("m.object_id").alias("instance_ids"))


def class_groups(objects: DataFrame) -> DataFrame:
    """(patch_id, group_id, category, instance_ids): classes with more than one object, cut-off ones included."""
    found = objects.groupBy("patch_id", "category").agg(
        F.sort_array(F.collect_list(F.struct("pos", "object_id"))).alias("m"), F.min("pos").alias("first_pos")
    )
    order = Window.partitionBy("patch_id").orderBy("first_pos")
    many = found.filter(F.size("m") > 1).withColumn("n", F.row_number().over(order) - 1)
    return many.select("patch_id", (1_000_000 + F.col("n")).cast("bigint").alias("group_id"), "category", F.col("m.object_id").alias("instance_ids"))


def pair_groups(objects: DataFrame, small: str = "Small_Vehicle", large: str = "Large_Vehicle") -> DataFrame:
    """(patch_id, group_id, category, instance_ids): both vehicle classes of a patch together."""
    both = objects.filter(F.col("category").isin(small, large)).groupBy("patch_id").agg(
        F.count_if(F.col("category") == small).alias("s"), F.count_if(F.col("category") == large).alias("l"),
        F.sort_array(F.collect_list(F.struct("pos", "object_id"))).alias("m"),
    )
    return both.filter("s > 0 and l > 0").select(
        "patch_id", F.lit(2_000_000).cast("bigint").alias("group_id"), F.lit("vehicle_pair").alias("category"), F.col("m.object_id").alias("instance_ids")
    )


def group_members(groups: DataFrame, objects: DataFrame) -> DataFrame:
    """(patch_id, group_id, category of the object, and its columns), one row per group and object."""
    inside = groups.select("patch_id", "group_id", F.explode("instance_ids").alias("object_id"))
    return inside.join(objects, ["patch_id", "object_id"])


def group_geometry(members: DataFrame) -> DataFrame:
    """(patch_id, group_id, size, cx, cy, xmin, ymin, xmax, ymax): mean centroid and box of all members, and category if members
    have group_category."""
    m = g.with_geometry(members)
    named = [F.max("group_category").alias("category")] if "group_category" in members.columns else []
    return m.groupBy("patch_id", "group_id").agg(
        *named,
        F.count("*").alias("size"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def group_category(members: DataFrame) -> DataFrame:
    """(patch_id, group_id, category): the only class, or the most frequent one, the first seen of ties; pairs have a
    name of their own."""
    counts = members.groupBy("patch_id", "group_id", "category").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    best = counts.groupBy("patch_id", "group_id").agg(F.max_by("category", F.struct("n", -F.col("p"))).alias("category"))
    return best.withColumn("category", F.when(F.col("group_id") >= 2_000_000, "vehicle_pair").otherwise(F.col("category")))


def relate_groups(geometry: DataFrame, base: float = 150.0) -> DataFrame:
    """(patch_id, source_id, target_id, direction, distance) of groups below the class level: not single to single, no
    box inside the other, centroids at most base apart; eight sectors."""
    e = geometry.filter("group_id < 1000000")
    c = F.col
    dx, dy = c("b_cx") - c("a_cx"), c("b_cy") - c("a_cy")
    apart = F.sqrt(dx * dx + dy * dy)
    on = (
        (c("a_group_id") != c("b_group_id")) & ((c("a_size") > 1) | (c("b_size") > 1)) & (apart <= base)
        & ~g.box_inside("a_", "b_") & ~g.box_inside("b_", "a_")
    )
    pairs = cell_join(e, e, ["patch_id"], F.lit(base), base, on)
    return pairs.select(
        "patch_id", c("a_group_id").alias("source_id"), c("b_group_id").alias("target_id"),
        g.group_direction(g.angle(c("a_cx"), c("a_cy"), c("b_cx"), c("b_cy"))).alias("direction"), apart.alias("distance"),
    )


def with_extremes(objects: DataFrame, width: int, height: int, margin: float = 0.05) -> DataFrame:
    """objects (with geometry) with extreme_position: outermost by more than the margin; of several the last named counts."""

    def outer(order: Column, axis: str, size: int) -> Column:
        w = Window.partitionBy("patch_id", "category").orderBy(order)
        gap = F.abs(F.lead(axis).over(w) - F.col(axis))
        return (F.row_number().over(w) == 1) & (gap > margin * size)

    marks = objects.withColumns({
        "_t": outer(F.col("cy").asc(), "cy", height), "_b": outer(F.col("cy").desc(), "cy", height),
        "_l": outer(F.col("cx").asc(), "cx", width), "_r": outer(F.col("cx").desc(), "cx", width),
    })
    named = F.when(F.col("_r"), "rightmost").when(F.col("_l"), "leftmost").when(F.col("_b"), "bottommost").when(F.col("_t"), "topmost")
    return marks.withColumn("extreme_position", named).drop("_t", "_b", "_l", "_r")


def extremes(objects: DataFrame, width: int, height: int, margin: float = 0.05) -> DataFrame:
    """(patch_id, object_id, extreme_position) of the outermost objects, see with_extremes()."""
    marks = with_extremes(g.with_geometry(objects), width, height, margin)
    return marks.select("patch_id", "object_id", "extreme_position").filter("extreme_position is not null")


def size_attribute(objects: DataFrame, width: int, height: int, ratio: float = 1.5) -> DataFrame:
    """(patch_id, object_id, size_attribute): largest or smallest of a class by the ratio to the next; the smallest is
    sought among objects whose box is inside the image."""
    o = g.with_geometry(objects)
    big = Window.partitionBy("patch_id", "category").orderBy(F.col("area").desc(), "object_id")
    largest = o.withColumn("next", F.lead("area").over(big)).withColumn("n", F.row_number().over(big))
    largest = largest.filter((F.col("n") == 1) & (F.col("area") > ratio * F.col("next"))).select("patch_id", "object_id", F.lit("largest").alias("size_attribute"))
    inside = o.filter((F.col("xmin") >= 0) & (F.col("ymin") >= 0) & (F.col("xmax") <= width) & (F.col("ymax") <= height))
    low = Window.partitionBy("patch_id", "category").orderBy("area", "object_id")
    smallest = inside.withColumn("next", F.lead("area").over(low)).withColumn("n", F.row_number().over(low))
    smallest = smallest.filter((F.col("n") == 1) & (ratio * F.col("area") < F.col("next"))).select("patch_id", "object_id", F.lit("smallest").alias("size_attribute"))
    return largest.unionByName(smallest)
