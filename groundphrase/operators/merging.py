"""Model replies merged into the table of phrases: what a target had from a model gives way to its newest reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of phrases that come from a model.
FROM_MODEL = ("enhanced", "unique", "unique_description")
KEY = ("patch_id", "target_kind", "target_id")


def _said_by(latest: DataFrame, key: list[str]) -> DataFrame:
    """(key, _t, _item, expr_type, text, _said): a reply's phrases that are not blank; _t orders the kinds, _item a kind's phrases."""
    row = lambda d, t, kind, text, said: d.select(*key, F.lit(t).alias("_t"), F.col("_item").cast("int").alias("_item"), F.lit(kind).alias("expr_type"), text.alias("text"), said.alias("_said"))
    none = F.lit(None).cast("string")
    old = latest.select(*key, F.posexplode("reply.enhanced_expressions").alias("_item", "e"))
    new = latest.select(*key, F.posexplode("reply.unique_expressions").alias("_item", "e"))
    told = latest.filter(F.exists("reply.unique_expressions", lambda u: F.trim(u) != "")).withColumn("_item", F.lit(0))
    out = row(old, 1, "enhanced", F.col("e.variation"), F.coalesce("e.original_expression", F.lit("")))
    out = out.unionByName(row(told, 2, "unique_description", F.col("reply.unique_description"), none)).unionByName(row(new, 3, "unique", F.col("e"), none))
    return out.filter(F.trim("text") != "")


def _nearest(key: list[str], original: Column) -> Column:
    """The original (pos, expr_id) whose length is nearest to that of _said, the earlier one of two: the nearest from below and
    the nearest from above, told by running windows over lengths, so that no reply meets every original."""
    w = Window.partitionBy(*key).orderBy("_len")
    below = F.max(F.when(original, F.struct("_len", (-F.col("pos")).alias("p"), "expr_id"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min(F.when(original, F.struct("_len", F.col("pos").alias("p"), "expr_id"))).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    down, up = F.col("_len") - below["_len"], above["_len"] - F.col("_len")
    lower = up.isNull() | (down < up) | ((down == up) & (-below["p"] <= above["p"]))
    return F.when(F.coalesce(lower, F.lit(False)) & below.isNotNull(), below["expr_id"]).otherwise(above["expr_id"])


def named(exprs: DataFrame) -> DataFrame:
    """exprs with expr_id (where there is none, the phrase's pos) and base_id."""
    given = exprs.columns
    for name, value in (("expr_id", F.col("pos").cast("string")), ("base_id", F.lit(None).cast("string"))):
        exprs = exprs.withColumn(name, F.coalesce(F.col(name), value) if name in given else value)
    return exprs


def merge_replies(exprs: DataFrame, replies: DataFrame, key: tuple[str, ...] = KEY, order: str | None = None) -> DataFrame:
    """exprs with the phrases of replies in place of those that the same targets had from a model before.

    exprs: key (the patch first), pos, expr_type, text, expr_id and base_id if there are such, and any more columns, which new
    phrases take from their target's first phrase. replies: key, reply (enrichment.REPLY) and `order`, by which the last of a
    target's replies counts (of equal ones, the last as JSON). An enhanced phrase belongs to the original of equal text, else to that
    of the nearest length, the earlier one of two; its base_id is that original's expr_id (its pos, where it has none) and its own
    expr_id `{base}_var_{j}`, numbered over the target. A target without originals gives the phrase's place in the reply as base.
    Unique phrases are `unique_{j}` by their place in the reply; a description counts only beside unique phrases. New phrases
    follow the target's own in pos. Null replies, blank phrases and replies without any change nothing; replies to targets that
    are not there go to unmatched_replies(). All windows follow one exchange by patch on either side.
    """
    keys, parts = list(key), int(exprs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exprs = named(exprs)
    out = exprs.columns
    others = [n for n in out if n not in (*keys, "pos", "expr_type", "text", "expr_id", "base_id")]
    newest = [*([F.col(order).desc_nulls_last()] if order else []), F.to_json("reply").desc()]
    heard = replies.filter("reply is not null").repartition(parts, keys[0])
    latest = heard.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter("_n = 1")
    own = exprs.repartition(parts, keys[0]).select(
        *keys, "pos", "expr_type", "text", "expr_id", "base_id", F.struct(F.lit(0).alias("_"), *others).alias("_more"), F.lit(0).alias("_t"), F.lit(None).cast("int").alias("_item"),
        F.when(F.col("expr_type") == "original", F.col("text")).alias("_said"),
    )
    d = own.unionByName(_said_by(latest, keys), allowMissingColumns=True).repartition(parts, keys[0]).withColumn("_len", F.length("_said"))
    whole, new = Window.partitionBy(*keys), F.col("_t") > 0
    original = (F.col("_t") == 0) & (F.col("expr_type") == "original") & F.col("text").isNotNull()
    model = F.col("expr_type").isin(*FROM_MODEL)
    exact = F.min(F.when(original, F.struct("pos", "expr_id"))).over(Window.partitionBy(*keys, "_said"))["expr_id"]
    d = d.withColumns({
        "_base": F.when(F.col("_t") == 1, F.coalesce(exact, _nearest(keys, original), F.col("_item").cast("string"))),
        "_known": F.max(F.col("_t") == 0).over(whole), "_new": F.max(new).over(whole),
        "_last": F.coalesce(F.max(F.when(~new & ~F.coalesce(model, F.lit(False)), F.col("pos"))).over(whole), F.lit(-1)),
        "_like": F.min_by("_more", F.when(~new, F.col("pos"))).over(whole),
    }).filter(F.col("_known") & (new | ~F.coalesce(model, F.lit(False)) | ~F.col("_new")))
    j = F.row_number().over(Window.partitionBy(*keys, "_t", "_base").orderBy("_item")) - 1
    place = F.row_number().over(Window.partitionBy(*keys, F.col("_t") > 0).orderBy("_t", "_item"))
    d = d.withColumns({"_j": j, "_place": place})
    own_id = F.when(F.col("_t") == 1, F.concat("_base", F.lit("_var_"), "_j")).when(F.col("_t") == 2, "unique_description").when(F.col("_t") == 3, F.concat(F.lit("unique_"), "_item"))
    kinds = {f.name: f.dataType for f in exprs.schema}
    told = {
        "pos": F.when(new, F.col("_last") + F.col("_place")).otherwise(F.col("pos")).cast(kinds["pos"]), "expr_id": F.when(new, own_id).otherwise(F.col("expr_id")),
        "base_id": F.when(new, F.col("_base")).otherwise(F.col("base_id")), **{n: F.when(new, F.col("_like")[n]).otherwise(F.col("_more")[n]) for n in others},
    }
    return d.select(*[told.get(n, F.col(n)).alias(n) for n in out])


def unmatched_replies(exprs: DataFrame, replies: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Replies to targets that the table does not have."""
    return replies.join(exprs.select(*key).distinct(), list(key), "left_anti")
