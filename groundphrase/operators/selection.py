"""Filters, samples and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.operators.raster import gray

CLASS_LEVEL, PAIR_LEVEL = 1_000_000, 2_000_000
#: Area, aspect and solidity that components of a class must have.
COMPONENT_RULES = {"building": (100, 50_000, 0.1, 10.0, 0.3), "water": (200, 200_000, 0.0, 1e9, 0.0), "road": (300, 1_000_000, 0.0, 1e9, 0.0)}


def hashed(seed: int, *ids: str) -> Column:
    """An order that looks random and stays the same under any partitioning."""
    return F.xxhash64(F.lit(seed), *ids)


def filter_id_range(df: DataFrame, id_col: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Ids from low to high, both included; a bound that is None is open."""
    if low is not None:
        df = df.filter(F.col(id_col) >= low)
    return df if high is None else df.filter(F.col(id_col) <= high)


def sample_n(df: DataFrame, n: int, by: str, id_col: str, order: Column | None = None, seed: int = 42) -> DataFrame:
    """n rows of each value of `by`, in hashed order of ids (or another order); the rank filter is pushed below the shuffle."""
    key = hashed(seed, id_col) if order is None else order
    w = Window.partitionBy(by).orderBy(key, id_col)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, by: str, key: Column, id_col: str, parts: int = 64) -> DataFrame:
    """Adds _n, the rank of a row in its value of `by` by (key, id) from 1, and _t, the number of such rows.

    key is a number. Its range in each value of `by` is cut into `parts` equal pieces, whose counts are summed up, so
    the largest value is ranked by as many tasks as it has rows for; null is a value of its own. Nothing is approximate: uneven pieces cost
    time only.
    """
    d = df.withColumns({"_g": F.struct(F.col(by)), "_k": key})  # structs with a null are equal in joins
    ends = d.groupBy("_g").agg(F.min("_k").cast("double").alias("_lo"), F.max("_k").cast("double").alias("_hi"))
    place = F.floor((F.col("_k").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * parts)
    d = d.join(ends, "_g").withColumn("_p", F.coalesce(place, F.lit(-1)))
    sizes = d.groupBy("_g", "_p").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_g")  # as many rows as parts
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_g", "_p", before.alias("_b"), F.sum("_c").over(whole).alias("_t"))
    inside = Window.partitionBy("_g", "_p").orderBy("_k", id_col)
    out = d.join(offsets, ["_g", "_p"]).withColumn("_n", F.row_number().over(inside) + F.col("_b"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "_n", "_t")


def sample_pct(df: DataFrame, pct: float, by: str, id_col: str, order: Column | None = None, seed: int = 42) -> DataFrame:
    """floor(count * pct / 100) rows of each value of `by`; order is a number."""
    key = hashed(seed, id_col) if order is None else order
    return ranked(df, by, key, id_col).filter(F.col("_n") <= F.floor(F.col("_t") * pct / 100)).drop("_n", "_t")


def split_ratio(df: DataFrame, ratio: float, id_col: str, order: Column | None = None, parts: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds split: the first floor(n * ratio) rows in the order (a number) are train, the others val; within `parts` if given."""
    key = hashed(seed, id_col) if order is None else order
    out = ranked(df.withColumn("_part", F.lit(0) if parts is None else parts), "_part", key, id_col)
    first = F.col("_n") <= F.floor(F.col("_t") * ratio)
    return out.withColumn("split", F.when(first, "train").otherwise("val")).drop("_part", "_n", "_t")


def filter_min_size(df: DataFrame, size: int) -> DataFrame:
    return df.filter((F.col("width") >= size) & (F.col("height") >= size))


def filter_too_black(pixels: DataFrame, share: float = 0.5, dark: int = 10, key: str = "image_id") -> DataFrame:
    """Images of which at most `share` of the pixels are darker than `dark`."""
    black = F.avg((gray() < dark).cast("int"))
    return pixels.groupBy(key).agg(black.alias("black_share")).filter(F.col("black_share") <= share)


def filter_expr_type(exprs: DataFrame, unique: bool = False, original: bool = False, enhanced: bool = False) -> DataFrame:
    """Phrases of one type; at most one flag may be set, none keeps all."""
    if unique + original + enhanced > 1:
        raise ValueError("only one kind of phrase may be asked for")
    kind = "unique" if unique else "original" if original else "enhanced" if enhanced else None
    return exprs if kind is None else exprs.filter(F.col("expr_type") == kind)


def expr_type(type_col: str = "_type", id_col: str = "_id") -> Column:
    """The type attribute, else enhanced if it names an original, else original."""
    return F.when(F.col(type_col).isNotNull(), F.col(type_col)).when(F.col(id_col).isNotNull(), "enhanced").otherwise("original")


def one_per_target(exprs: DataFrame) -> DataFrame:
    """The first unique phrase of each target."""
    w = Window.partitionBy("patch_id", "target_kind", "target_id").orderBy("pos")
    return exprs.filter("expr_type = 'unique'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def filter_targets(exprs: DataFrame, mode: str = "all") -> DataFrame:
    """all, individual (ids below the class level), or class level."""
    if mode == "all":
        return exprs
    if mode == "individual":
        return exprs.filter("target_kind = 'individual'")
    if mode == "class":
        return exprs.filter(F.col("target_id").between(CLASS_LEVEL, PAIR_LEVEL - 1))
    raise ValueError(mode)


def drop_cutoff(exprs: DataFrame, objects: DataFrame) -> DataFrame:
    """Phrases of objects that are not cut off."""
    gone = objects.filter("is_cutoff").select(F.col("object_id").alias("target_id"))
    return exprs.join(gone, "target_id", "left_anti")


def drop_empty_targets(targets: DataFrame, exprs: DataFrame, key: list[str]) -> DataFrame:
    """Targets that have phrases; patches without such targets go with them."""
    return targets.join(exprs.select(*key).distinct(), key, "left_semi")


def pending_targets(exprs: DataFrame) -> DataFrame:
    """(patch_id) of patches with a target that lacks an enhanced or a unique phrase."""
    has = exprs.groupBy("patch_id", "target_kind", "target_id").agg(
        (F.bool_or(F.col("expr_type") == "enhanced") & F.bool_or(F.col("expr_type") == "unique")).alias("done")
    )
    return has.groupBy("patch_id").agg(F.bool_and("done").alias("done")).filter("not done").select("patch_id")


def reset_enrichment(exprs: DataFrame) -> DataFrame:
    return exprs.filter(~F.col("expr_type").isin("enhanced", "unique"))


def purge_plan(files: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    """(kind, n): how many files of each ending a rule would delete. Nothing is deleted."""
    hit = files.filter(F.col(name_col).rlike(pattern))
    return hit.groupBy(F.regexp_extract(name_col, r"\.([^.]+)$", 1).alias("kind")).agg(F.count("*").alias("n"))


def exclude_prefix(df: DataFrame, prefix: str, col: str = "name") -> DataFrame:
    return df.filter(~F.startswith(F.col(col), F.lit(prefix)))


def filter_components(components: DataFrame, rules: dict = COMPONENT_RULES) -> DataFrame:
    """Components (category, area, aspect, solidity) within the limits of their class; unknown classes go."""
    rows = [(k, *map(float, v)) for k, v in rules.items()]
    t = components.sparkSession.createDataFrame(rows, "category string, lo double, hi double, thin double, wide double, solid double")
    keep = F.col("area").between(F.col("lo"), F.col("hi")) & F.col("aspect").between(F.col("thin"), F.col("wide")) & (F.col("solidity") >= F.col("solid"))
    return components.join(F.broadcast(t), "category").filter(keep).select(*components.columns)


def filter_class_area(pixels: DataFrame, least: int = 100) -> DataFrame:
    """(image_id, class_id, n) of classes with enough pixels in an image."""
    return pixels.groupBy("image_id", "class_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def valid_llm_items(df: DataFrame) -> DataFrame:
    """Items with a phrase that is not blank and a box."""
    box = F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull()
    return df.filter((F.trim("text") != "") & box)


def require_image(samples: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return samples.join(files.select(on).distinct(), on, "left_semi")


def patches_of(files: DataFrame, image: str, name_col: str = "name") -> DataFrame:
    return files.filter(F.startswith(F.col(name_col), F.lit(f"{image}_patch_"))).orderBy(name_col)


def random_effect(key: Column, pct: int, effects: list[str]) -> Column:
    """One of the effects for pct per cent of the keys, null for the others."""
    chosen = F.element_at(F.array(*map(F.lit, effects)), (F.pmod(F.floor(key / 100), F.lit(len(effects))) + 1).cast("int"))
    return F.when(F.pmod(key, F.lit(100)) < pct, chosen)


def first_round(exprs: DataFrame) -> DataFrame:
    """Phrases up to the second unique one of a target, or up to an enhanced one after a unique one."""
    w = Window.partitionBy("patch_id", "target_kind", "target_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    unique = (F.col("expr_type") == "unique").cast("int")
    d = exprs.withColumn("_u", F.coalesce(F.sum(unique).over(before), F.lit(0)))
    stop = (F.col("_u") >= 2) | (F.col("expr_type") == "enhanced") & (F.col("_u") > 0)
    d = d.withColumn("_s", F.sum(stop.cast("int")).over(w))
    return d.filter("_s = 0").drop("_u", "_s")


def assign_effects(images: DataFrame, by: str, id_col: str, order: Column | None = None, n: int = 3, seed: int = 42) -> DataFrame:
    """Adds effect 1..n in equal parts of each value of `by`; what is left over goes to the first. order is a number."""
    key = hashed(seed, id_col) if order is None else order
    small, more = F.floor(F.col("_t") / n), F.col("_t") % n  # the first `more` effects have one row more
    at, long = F.col("_n") - 1, F.floor(F.col("_t") / n) + 1
    effect = F.when(at < more * long, F.floor(at / long)).otherwise(more + F.floor((at - more * long) / F.greatest(small, F.lit(1))))
    return ranked(images, by, key, id_col).withColumn("effect", (effect + 1).cast("int")).drop("_n", "_t")


def effect_counts(images: DataFrame, by: str = "split") -> DataFrame:
    """(by, effect, n) of images with an effect."""
    return images.groupBy(by, "effect").agg(F.count("*").alias("n"))


def assign_transfers(images: DataFrame, domains: list[str], id_col: str, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds target: half of a domain (the greater) stays (null), the rest goes to the two other domains in turn, the
    first getting what is left over. order is a number."""
    key = hashed(seed, id_col) if order is None else order
    d = ranked(images, "domain", key, id_col)
    moved = F.floor(F.col("_t") / 2)
    at = F.col("_n") - (F.col("_t") - moved)
    first, second = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x in domains:
        others = [y for y in domains if y != x]
        first, second = F.when(F.col("domain") == x, others[0]).otherwise(first), F.when(F.col("domain") == x, others[1]).otherwise(second)
    target = F.when(at <= 0, F.lit(None)).when(at <= F.ceil(moved / 2), first).otherwise(second)
    return d.withColumn("target", target).drop("_n", "_t")


def first_matching(df: DataFrame, key: list[str], test: Column, order: str) -> DataFrame:
    """(key, order): of each key the first row that passes the test, else the first row. A partial aggregate, no window,
    for keys that hold many rows; a test that is null is not passed."""
    best = F.min(F.struct((~F.coalesce(test, F.lit(False))).alias("other"), F.col(order))).alias("b")
    return df.groupBy(*key).agg(best).select(*key, F.col(f"b.{order}").alias(order))


def filter_domain(files: DataFrame, domain: str) -> DataFrame:
    return files.filter(F.col("domain") == domain)


def clean_columns(df: DataFrame, keep: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Only the columns to publish, some under other names; one that is not there is passed over."""
    return df.select(*[F.col(f"`{c}`").alias((renamed or {}).get(c, c)) for c in keep if c in df.columns])


def sample_with_classes(pixels: DataFrame, classes: list[int], n: int, order: Column | None = None, least: int = 100, seed: int = 42) -> DataFrame:
    """(image_id): n random images with `least` or more pixels of these classes."""
    hit = pixels.groupBy("image_id").agg(F.count_if(F.col("class_id").isin(classes)).alias("n")).filter(F.col("n") >= least)
    return hit.orderBy(hashed(seed, "image_id") if order is None else order, "image_id").limit(n).select("image_id")


def latest_result(results: DataFrame, by: str, time_col: str, id_col: str) -> DataFrame:
    """(by, id) of the last result of each value of `by`; of equal times the greater id."""
    return results.groupBy(by).agg(F.max_by(id_col, F.struct(time_col, id_col)).alias(id_col))


def top_by_count(df: DataFrame, key: Column | str, n: int, name: str = "image") -> DataFrame:
    """(name, n): the n most frequent values; ties by value."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def rank_by_count(df: DataFrame, key: str) -> DataFrame:
    """(key, n, rank): values by their count, ties by value. One window over all values: for keys with few, such as classes."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def order_categories(df: DataFrame, fixed: list[str], key: str = "category") -> DataFrame:
    """(key, n, ord): the named values in their order, the others after them by name with a null ord."""
    known = df.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(fixed)], f"{key} string, ord int")
    return df.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(known), key, "left").orderBy(F.asc_nulls_last("ord"), key)


def sample_items(df: DataFrame, group: str, n_groups: int, n: int, group_order: Column, order: list[Column | str]) -> DataFrame:
    """n rows, in an order that looks random, out of n_groups groups that are chosen likewise."""
    groups = df.select(group).distinct().orderBy(group_order, group).limit(n_groups)
    return df.join(groups, group, "left_semi").orderBy(*order).limit(n)


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """Any n rows: reading stops early."""
    return df.limit(n)


def combine_datasets(parts: dict[str, DataFrame], exclude: tuple[str, ...] = ()) -> DataFrame:
    """The named tables as one, with their names as dataset; columns that a table lacks are null."""
    kept = [df.withColumn("dataset", F.lit(k)) for k, df in parts.items() if k not in exclude]
    return combine(*kept)


def combine(*parts: DataFrame) -> DataFrame:
    """All rows of some tables, such as both splits; columns that a table lacks are null."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def missing_values(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key): values that are expected and not found."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def class_presence(pixels: DataFrame, phrases: DataFrame) -> DataFrame:
    """(image_id, class_id, phrase): one sample for each class that an image shows, with the class's phrase; classes without
    one are passed over."""
    return pixels.select("image_id", "class_id").distinct().join(phrases.select("class_id", "phrase"), "class_id").select("image_id", "class_id", "phrase")


def assign_ids(df: DataFrame, group: str, order: list[str], id_col: str = "new_id", parts: int = 64) -> DataFrame:
    """Running ids from 1: the rank inside a group (a number) plus the rows of all groups before it.

    Groups' counts are summed over ranges of groups first, so no window holds all rows or all groups; groups are ranged by
    their rank among the ends, read by a subquery of the same plan."""
    counts = df.groupBy(group).agg(F.count("*").alias("_c"))
    low, high = (counts.agg(f(F.col(group).cast("double"))).scalar() for f in (F.min, F.max))
    place = F.floor((F.col(group).cast("double") - low) / (high - low + 1) * parts)
    counts = counts.withColumn("_r", F.coalesce(place, F.lit(-1)))
    totals = counts.groupBy("_r").agg(F.sum("_c").alias("_t"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0))).select("_r", "_s")  # a row a range
    inside = Window.partitionBy("_r").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(F.broadcast(starts), "_r")
    offsets = offsets.select(F.struct(group).alias("_g"), (F.col("_o") + F.col("_s")).alias("_b"))  # null is a group, too
    w = Window.partitionBy(group).orderBy(*order)
    numbered = df.withColumns({"_n": F.row_number().over(w), "_g": F.struct(group)}).join(offsets, "_g")
    return numbered.withColumn(id_col, F.col("_n") + F.col("_b")).select(*df.columns, id_col)
