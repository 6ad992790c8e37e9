"""Statistics of datasets, scores and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.functions.phrases import domain_of


def _n(on: Column) -> Column:
    return F.count_if(on)


def dataset_stats(exprs: DataFrame) -> DataFrame:
    """By split, and in total (split null): patches, targets of either kind, samples (all targets), phrases by type and
    phrases per target. Phrases are counted by target first, so the distinct counts see targets only."""
    kind = lambda k: F.col("target_kind") == k
    target = lambda k: F.when(kind(k), F.struct("patch_id", "target_id"))
    types = ("original", "enhanced", "unique")
    t = exprs.groupBy("split", "patch_id", "target_kind", "target_id").agg(
        F.count("*").alias("n"), *[_n(F.col("expr_type") == x).alias(x) for x in types]
    )
    out = t.rollup("split").agg(
        F.count_distinct("patch_id").alias("patches"),
        F.count_distinct(target("individual")).alias("objects"),
        F.count_distinct(target("group")).alias("groups"),
        *[F.coalesce(F.sum(F.when(kind(k), F.col("n"))), F.lit(0)).alias(name) for k, name in (("individual", "object_phrases"), ("group", "group_phrases"))],
        *[F.sum(x).alias(x) for x in types],
        F.sum("n").alias("phrases"),
    )
    per = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return out.withColumns({"per_object": per("object_phrases", "objects"), "per_group": per("group_phrases", "groups")})


def category_stats(exprs: DataFrame, objects: DataFrame) -> DataFrame:
    """By class: objects with phrases, phrases by type, and the source domain, or Mixed."""
    o = objects.select(F.col("object_id").alias("target_id"), "category", "domain")
    return exprs.filter("target_kind = 'individual'").join(o, "target_id").groupBy("category").agg(
        F.count_distinct("target_id").alias("targets"),
        *[_n(F.col("expr_type") == t).alias(t) for t in ("original", "enhanced", "unique")],
        F.when(F.count_distinct("domain") > 1, "Mixed").otherwise(F.min("domain")).alias("domain"),
    )


def llm_share(exprs: DataFrame) -> DataFrame:
    """Phrases by split and type with all totals (null); share of the split's phrases."""
    out = exprs.cube("split", "expr_type").agg(F.count("*").alias("n"))
    whole = out.filter("expr_type is null").select(F.col("split").alias("s"), F.col("n").alias("whole"))
    return out.join(F.broadcast(whole), F.col("split").eqNullSafe(F.col("s"))).select(
        "split", "expr_type", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share")
    )


def quality_metrics(exprs: DataFrame) -> DataFrame:
    """By split: targets, those without unique phrases, pairs, and averages of phrases per target and patch."""
    t = exprs.groupBy("split", "patch_id", "target_kind", "target_id").agg(
        F.count("*").alias("n"), _n(F.col("expr_type") == "unique").alias("u")
    )
    return t.groupBy("split").agg(
        F.count("*").alias("targets"), _n(F.col("u") == 0).alias("without_unique"),
        _n(F.col("target_id") >= 1_000_000).alias("class_level"), F.round(F.avg("n"), 4).alias("per_target"),
        F.round(F.sum("n") / F.count_distinct("patch_id"), 4).alias("per_patch"),
    )


def target_metrics(objects: DataFrame, exprs: DataFrame, pair_level: int = 2_000_000, special: Column | None = None) -> DataFrame:
    """By split: objects, those skipped (no phrase), those without a mask, and targets that are special pairs.

    objects has split, patch_id, object_id and mask (null or empty: missing). special tells the phrases of special pairs where
    numbers can't, since objects' own reach the level; else the numbers from pair_level on are theirs."""
    said = exprs.filter("target_kind = 'individual'").select("patch_id", F.col("target_id").alias("object_id")).distinct()
    o = objects.join(said.withColumn("said", F.lit(True)), ["patch_id", "object_id"], "left")
    seen = o.groupBy("split").agg(
        F.count("*").alias("objects"), _n(F.col("said").isNull()).alias("skipped"), _n(F.coalesce(F.length("mask"), F.lit(0)) == 0).alias("without_mask")
    )
    paired = F.col("target_id") >= pair_level if special is None else special
    pairs = exprs.filter(paired).groupBy("split").agg(F.count_distinct("patch_id", "target_id").alias("pairs"))
    return seen.join(pairs, "split", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def enrichment_mismatch(exprs: DataFrame) -> DataFrame:
    """Patches whose counts of original and enhanced phrases differ."""
    c = exprs.groupBy("patch_id").agg(
        _n(F.col("expr_type") == "original").alias("original"), _n(F.col("expr_type") == "enhanced").alias("enhanced")
    )
    return c.filter("original <> enhanced")


def share_of_total(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by some columns and their percentage of all rows; the total is a scalar subquery."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(*by, "n", F.round(100 * F.col("n") / total, 4).alias("percent"))


def count_by_threshold(exprs: DataFrame, threshold: int = 1_000_000) -> DataFrame:
    return exprs.groupBy("split").agg(
        _n(F.col("target_id") < threshold).alias("instance"), _n(F.col("target_id") >= threshold).alias("semantic")
    )


def word_counts(exprs: DataFrame, top: int = 200) -> DataFrame:
    words = exprs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def batch_usage(results: DataFrame, price_in: float = 0.05, price_out: float = 0.20, all_patches: int = 71_721) -> DataFrame:
    """One row: requests, successes, patches, tokens, averages, cost (prices per million tokens) and its extrapolation."""
    out = results.agg(
        F.count("*").alias("requests"), _n(F.col("ok")).alias("successes"), F.count_distinct("patch_id").alias("patches"),
        F.sum(F.when(F.col("ok"), F.col("tokens_in"))).alias("tokens_in"), F.sum(F.when(F.col("ok"), F.col("tokens_out"))).alias("tokens_out"),
    )
    cost = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return out.withColumns({
        "mean_in": F.round(F.col("tokens_in") / F.nullif(F.col("successes"), F.lit(0)), 4), "cost": F.round(cost, 6),
        "cost_all": F.round(cost * all_patches / F.nullif(F.col("patches"), F.lit(0)), 4),
    })


def tokens_by_modality(results: DataFrame) -> DataFrame:
    """(modality, requests, tokens, mean) of successful results; details is array<struct<modality, tokens>> of a request, in
    which a modality may come several times."""
    d = results.filter("ok").select("request_id", F.explode("details").alias("d")).select("request_id", "d.*").filter("modality is not null")
    each = d.groupBy("request_id", "modality").agg(F.sum("tokens").alias("n"))
    return each.groupBy("modality").agg(F.count("*").alias("requests"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 4).alias("mean"))


def cost_table(results: DataFrame, prices: DataFrame, requests: int = 300_000) -> DataFrame:
    """By model: mean tokens, price per request and for many requests."""
    mean = results.groupBy("model").agg(F.avg("tokens_in").alias("i"), F.avg("tokens_out").alias("o"), F.count("*").alias("n"))
    each = (F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out")) / 1e6
    return mean.join(F.broadcast(prices), "model").select(
        "model", "n", F.round(each, 8).alias("per_request"), F.round(each * requests, 4).alias("for_many")
    )


def iou(inter: Column, union: Column) -> Column:
    """Intersection over union; 0 for an empty union and for what is no number."""
    x = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def exact_median(df: DataFrame, group: str, value: str, bins: int = 4096) -> DataFrame:
    """(group, median) of values from 0 to 1, exactly and without a buffer of all of them: a histogram finds the bins of
    the middle ranks, and only the different values of these bins are then counted in order."""
    d = df.select(group, F.col(value).alias("_v"), F.floor(F.col(value) * bins).alias("_b"))
    bars = d.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(group)  # a row a bin
    upto = F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    bars = bars.withColumns({"_before": upto - F.col("_c"), "_t": F.sum("_c").over(whole)})
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor((F.col("_t") + 2) / 2)
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_c"))
    wanted = bars.filter(holds(low) | holds(high)).select(group, "_b", "_before", low.alias("_low"), high.alias("_high"))
    inside = d.join(wanted, [group, "_b"]).groupBy(group, "_b", "_before", "_low", "_high", "_v").agg(F.count("*").alias("_c"))
    at = F.col("_before") + F.sum("_c").over(Window.partitionBy(group, "_b").orderBy("_v"))
    ranked = inside.withColumn("_at", at)
    first = lambda rank: F.min(F.when(F.col("_at") >= F.col(rank), F.col("_v")))
    return ranked.groupBy(group).agg(((first("_low") + first("_high")) / 2).alias("median"))


def seg_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and overall IoU, pass rates, least, greatest and median, over rows (inter, union_)."""
    s = scores.withColumns({"iou": iou(F.col("inter"), F.col("union_")), "_g": F.struct(*by) if by else F.lit(0)})
    rate = lambda t: F.round(F.avg((F.col("iou") >= t).cast("int")), 6).alias(f"pass_{int(t * 100)}")
    out = s.groupBy(*(["_g", *by] if by else [])).agg(
        F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("miou"), F.round(F.sum("inter") / F.sum("union_"), 6).alias("oiou"),
        rate(0.5), rate(0.7), rate(0.9), F.round(F.min("iou"), 6).alias("least"), F.round(F.max("iou"), 6).alias("greatest"),
    )
    out = out if by else out.withColumn("_g", F.lit(0))
    return out.join(exact_median(s, "_g", "iou"), "_g", "left").drop("_g").withColumn("median", F.round("median", 6))


def iou_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths from the least to the greatest IoU; the greatest is in the last bin."""
    s = scores.select(iou(F.col("inter"), F.col("union_")).alias("iou"))
    low, high = s.agg(F.min("iou")).scalar(), s.agg(F.max("iou")).scalar()
    place = F.floor((F.col("iou") - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    b = F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))
    return s.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def class_distribution(pixels: DataFrame) -> DataFrame:
    """(split, class_id, n, percent of the split)."""
    counts = pixels.groupBy("split", "class_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))  # a row per class
    return counts.withColumn("percent", F.round(100 * F.col("n") / total, 4))


def mask_encoding_profile(pixels: DataFrame) -> DataFrame:
    """Per image and overall (null): the distinct values as text, least and greatest."""
    v = pixels.select("image_id", "class_id").distinct()
    return v.rollup("image_id").agg(
        F.array_join(F.sort_array(F.collect_set("class_id")), ",").alias("seen"), F.min("class_id").alias("least"), F.max("class_id").alias("greatest")
    )


def class_examples(presence: DataFrame) -> DataFrame:
    """(class_id, first image, images) of rows (image_id, class_id)."""
    return presence.groupBy("class_id").agg(F.min("image_id").alias("first_image"), F.count("*").alias("images"))


def merge_refs(refs: DataFrame) -> DataFrame:
    """References with the same image, phrase and split as one, with their ids in order."""
    return refs.groupBy("patch_id", "text", "split").agg(F.sort_array(F.collect_list("target_id")).alias("ids"))


def source_stats(images: DataFrame) -> DataFrame:
    """By split: images, instances, resolutions of the least and greatest image by area, mean sides."""
    area = F.struct(F.col("width") * F.col("height"), F.col("image_id"))
    said = F.concat_ws("x", "width", "height")
    return images.groupBy("split").agg(
        F.count("*").alias("images"), F.sum("instances").alias("instances"), F.min_by(said, area).alias("least"),
        F.max_by(said, area).alias("greatest"), F.round(F.avg("width"), 4).alias("mean_width"), F.round(F.avg("height"), 4).alias("mean_height"),
    )


def publication_stats(samples: DataFrame) -> DataFrame:
    """(dimension, value, n, images): samples and images by split, type, kind, domain and category, and of all (dimension
    and value null). Samples are counted by image first; the sets are grouped over these counts. A null value is "none"."""
    dims = ["split", "expr_type", "target_kind", "domain", "category"]
    d = samples.withColumns({x: F.coalesce(F.col(x).cast("string"), F.lit("none")) for x in dims})
    counts = d.groupBy("image", *dims).agg(F.count("*").alias("n"))
    sets = counts.groupingSets([[], *([d] for d in dims)], *dims).agg(F.sum("n").alias("n"), F.count_distinct("image").alias("images"), F.grouping_id().alias("g"))
    name = F.lit(None).cast("string")
    for i, x in enumerate(dims):
        name = F.when(F.col("g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, x).otherwise(name)
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n", "images")


def label_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    """Counts of human labels."""
    return labels.groupBy(*by).agg(F.count("*").alias("n"))


def run_totals(results: DataFrame, by: str) -> DataFrame:
    """By run: items, those done (ok), retries (the sum of tries) and the success rate in per cent."""
    ok = _n(F.col("ok"))
    return results.groupBy(by).agg(
        F.count("*").alias("items"), ok.alias("done"), F.sum("tries").alias("retries"), F.round(100 * ok / F.count("*"), 4).alias("success")
    )


def merge_split_stats(stats: DataFrame, key: str) -> DataFrame:
    """(key, train, val, total) of rows (key, split, n) over all keys."""
    p = stats.groupBy(key).pivot("split", ["train", "val"]).agg(F.sum("n")).na.fill(0)
    return p.withColumn("total", F.col("train") + F.col("val"))


#: Columns of the published dataset table.
MEASURES = ["patches", "objects", "groups", "samples", "object_phrases", "group_phrases", "original", "enhanced", "unique", "phrases"]


def published_tables(exprs: DataFrame) -> dict[str, DataFrame]:
    """The tables that validate_tables() compares: dataset (by split train, val and total), llm shares and taxonomy by split.

    A patch counts once in the split of each of its phrases, so totals are sums of splits."""
    d = dataset_stats(exprs).filter("split is not null").withColumn("samples", F.col("objects") + F.col("groups")).select("split", *MEASURES)
    total = d.agg(*[F.sum(m).alias(m) for m in MEASURES]).select(F.lit("total").alias("split"), *MEASURES)
    types = exprs.rollup("expr_type", "split").agg(F.count("*").alias("n")).filter("expr_type is not null")
    kinds = exprs.groupBy("target_kind", "split").agg(F.count("*").alias("n"))
    return {"dataset": d.unionByName(total), "llm": types.select("expr_type", F.coalesce("split", F.lit("total")).alias("split"), "n"), "kinds": kinds}


def validate_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, expected, actual, ok): whether published tables agree with themselves and each other.

    splits: train and val make the total, for each measure; samples: objects and groups make the samples of a split;
    kinds and types: phrases by kind and by type make all phrases; llm: the share table has the dataset table's counts
    by type, and its subtotals; by_kind: the same for a table of kinds."""
    data = tables["dataset"].unpivot(["split"], MEASURES, "measure", "n")
    parts = data.groupBy("measure").agg(
        F.sum(F.when(F.col("split") != "total", F.col("n"))).alias("expected"), F.sum(F.when(F.col("split") == "total", F.col("n"))).alias("actual")
    ).select(F.concat(F.lit("splits/"), "measure").alias("check_name"), "expected", "actual")
    sums = {"samples": (["objects", "groups"], "samples"), "kinds": (["object_phrases", "group_phrases"], "phrases"),
            "types": (["original", "enhanced", "unique"], "phrases")}
    rows = [parts]
    for name, (summed, whole) in sums.items():
        expected = sum((F.col(x) for x in summed[1:]), F.col(summed[0]))
        rows.append(tables["dataset"].select(F.concat(F.lit(f"{name}/"), "split").alias("check_name"), expected.alias("expected"), F.col(whole).alias("actual")))
    key = ["measure", "split"]
    told = tables["llm"].select(F.col("expr_type").alias("measure"), "split", F.col("n").alias("actual"))
    named = {"individual": "object_phrases", "group": "group_phrases"}
    kind = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    by_kind = tables["kinds"].select(F.try_element_at(kind, F.col("target_kind")).alias("measure"), "split", F.col("n").alias("actual"))
    for name, t in (("llm", told), ("by_kind", by_kind)):
        both = t.join(data.withColumnRenamed("n", "expected"), key, "left")
        rows.append(both.select(F.concat_ws("/", F.lit(name), "measure", "split").alias("check_name"), "expected", "actual"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def with_domain(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("domain", domain_of(F.col(name)))
