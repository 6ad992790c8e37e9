"""Writers: annotations, requests, samples, chats and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_annotations_xml(documents: DataFrame, path: str) -> None:
    """One <annotation> row per patch document; Spark writes a file per task, each under one root."""
    documents.write.option("rootTag", "annotations").option("rowTag", "annotation").xml(path)


def annotation_documents(patches: DataFrame, objects: DataFrame) -> DataFrame:
    """(patch_id, filename, width, height, object array): a patch's document, objects in order of pos."""
    cell = F.struct("pos", "object_id", "category", "xmin", "ymin", "xmax", "ymax", "is_cutoff")
    inner = objects.groupBy("patch_id").agg(F.sort_array(F.collect_list(cell)).alias("m"))
    shown = F.transform("m", lambda o: F.struct(
        o["object_id"].alias("id"), o["category"].alias("name"), F.struct(o["xmin"], o["ymin"], o["xmax"], o["ymax"]).alias("bndbox"), o["is_cutoff"].alias("is_cutoff")))
    return patches.join(inner, "patch_id", "left").select("patch_id", "filename", "width", "height", F.coalesce(shown, F.array().cast("array<struct<id:bigint,name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,is_cutoff:boolean>>")).alias("object"))


def full_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Documents with all that the rules have found: the inverse of explode_documents().

    tables: patches, objects and, where there are such, relations, groups, group_relations and expressions, all with
    filename. Objects and groups are in the order of their ids, relations by distance, expressions by pos."""
    key, have = ["filename"], set(tables)

    def gathered(df: DataFrame, by: list[str], order: list[str], cell: Column, name: str) -> DataFrame:
        row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], cell.alias("c"))
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(row))["c"].alias(name))

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ","))

    def said(kind: str, target: str) -> DataFrame:
        e = tables["expressions"].filter(F.col("target_kind") == kind).withColumnRenamed("target_id", target)
        mark = F.struct(
            F.col("text").alias("_VALUE"), F.when(F.col("expr_type") == "enhanced", F.col("pos").cast("string")).alias("_id"),
            F.when(~F.col("expr_type").isin("original", "enhanced"), F.col("expr_type")).alias("_type"),
        )
        lists = gathered(e, [*key, target], ["pos"], mark, "e").select(*key, target, F.struct(F.col("e").alias("expression")).alias("expressions"))
        dummies = e.filter("is_dummy").groupBy(*key, target).agg(F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), ",").alias("dummy_expression_ids"))
        return lists.join(dummies, [*key, target], "left")

    def fields(df: DataFrame, kinds: dict[str, tuple[str | Column, str]]) -> Column:
        cell = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)) if isinstance(c, str) else c
        return F.struct(*[cell(c, kind).cast(kind).alias(name) for name, (c, kind) in kinds.items()])

    related = "struct<relationship:array<struct<target_id:bigint,target_category:string,direction:string,distance:double,is_cutoff:boolean,is_borderline:boolean,possible_directions:string>>>"
    expressed = "struct<expression:array<struct<_VALUE:string,_id:string,_type:string>>>"
    o = tables["objects"]
    if "relations" in have:
        told = F.struct("target_id", "target_category", "direction", "distance", F.col("target_cutoff").alias("is_cutoff"), "is_borderline", listed("possible_directions").alias("possible_directions"))
        lists = gathered(tables["relations"], [*key, "object_id"], ["distance", "target_id", "direction"], told, "r")
        o = o.join(lists.select(*key, "object_id", F.struct(F.col("r").alias("relationship")).alias("relationships")), [*key, "object_id"], "left")
    if "expressions" in have:
        o = o.join(said("individual", "object_id"), [*key, "object_id"], "left")
    one = fields(o, {
        "id": ("object_id", "bigint"), "name": ("category", "string"), "bndbox": (F.struct("xmin", "ymin", "xmax", "ymax"), "struct<xmin:int,ymin:int,xmax:int,ymax:int>"),
        "is_cutoff": ("is_cutoff", "boolean"), "grid_position": ("grid_position", "string"), "extreme_position": ("extreme_position", "string"), "size_attribute": ("size_attribute", "string"),
        "color": ("colour", "string"), "is_ambiguous": ("is_ambiguous", "boolean"), "possible_colors": (listed("possible_colours") if "possible_colours" in o.columns else F.lit(None), "string"),
        "relationships": ("relationships", related), "segmentation": ("mask", "string"), "expressions": ("expressions", expressed), "dummy_expression_ids": ("dummy_expression_ids", "string"),
    })
    docs = tables["patches"].join(gathered(o, key, ["object_id"], one, "object"), "filename", "left")
    if "groups" in have:
        g = tables["groups"]
        if "expressions" in have:
            g = g.join(said("group", "group_id"), [*key, "group_id"], "left")
        cell = fields(g, {
            "id": ("group_id", "bigint"), "instance_ids": (listed("instance_ids"), "string"), "size": ("size", "int"), "category": ("category", "string"), "grid_position": ("grid_position", "string"),
            "centroid": ("centroid", "struct<x:double,y:double>"), "segmentation": ("mask", "string"), "expressions": ("expressions", expressed), "dummy_expression_ids": ("dummy_expression_ids", "string"),
        })
        lists = gathered(g, key, ["group_id"], cell, "g")
        if "group_relations" in have:
            between = F.struct("source_id", "target_id", "direction", "distance")
            lists = lists.join(gathered(tables["group_relations"], key, ["source_id", "distance", "target_id"], between, "r"), key, "left")
        inner = [F.col("g").alias("group")] + ([F.when(F.col("r").isNotNull(), F.struct(F.col("r").alias("relationship"))).alias("relationships")] if "group_relations" in have else [])
        docs = docs.join(lists.select(*key, F.array(F.struct(*inner)).alias("groups")), key, "left")
    return docs.select("filename", "width", "height", "object", *(["groups"] if "groups" in have else []))


def json_lines(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, path: str, by: list[str]) -> None:
    """Column value as text lines, in folders of `by`."""
    df.select("value", *by).write.partitionBy(*by).text(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Request lines (split, value) as text, one folder per split."""
    write_lines(requests, path, ["split"])


def write_patches(images: DataFrame, path: str) -> None:
    """Pictures (split, image_id, width, height, data) as binary columns, one folder per split."""
    images.write.partitionBy("split").parquet(path)


#: The columns of a published sample, their types, and what stands for null.
SAMPLE = {
    "image": ("binary", "cast('' AS binary)"),
    "image_filename": ("string", "''"),
    "xml_filename": ("string", "''"),
    "split": ("string", "''"),
    "domain_name": ("string", "'Unknown'"),
    "domain_id": ("int", "-1"),
    "image_width": ("int", "0"),
    "image_height": ("int", "0"),
    "object_type": ("string", "''"),
    "object_id": ("string", "''"),
    "category": ("string", "''"),
    "bbox": ("struct<xmin:int,ymin:int,xmax:int,ymax:int>", "named_struct('xmin', 0, 'ymin', 0, 'xmax', 0, 'ymax', 0)"),
    "area": ("int", "0"),
    "possible_colors": ("array<string>", "array()"),
    "rle_mask": ("struct<size:array<int>,counts:string>", "named_struct('size', array(), 'counts', '')"),
    "expression_id": ("string", "''"),
    "expression_text": ("string", "''"),
    "expression_type": ("string", "'original'"),
    "group_id": ("string", "''"),
    "group_size": ("int", "0"),
    "instance_ids": ("array<string>", "array()"),
    "centroid": ("struct<x:float,y:float>", "named_struct('x', 0, 'y', 0)"),
    "grid_position": ("string", "''"),
}
#: Numbers of the source domains.
DOMAIN_IDS = {"iSAID": 0, "LoveDA": 1, "DeepGlobe": 2}


def published(samples: DataFrame) -> DataFrame:
    """Samples with the declared columns, in their order and types; missing columns and nulls get the declared values, in
    the fields of bbox, rle_mask and centroid, too. A mask is a JSON text {"size": [h, w], "counts": "..."}; area and
    centroid follow from the box where they are not given."""
    have = set(samples.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    box = [col(x).cast("int") for x in ("xmin", "ymin", "xmax", "ymax")]
    group, target = col("target_kind") == "group", col("target_id").cast("string")
    mask = F.from_json(col("mask").cast("string"), "struct<size:array<int>,counts:string>")
    ids = F.create_map(*[F.lit(x) for pair in DOMAIN_IDS.items() for x in pair])
    centre = F.struct(((box[0] + box[2]) / 2).cast("float").alias("x"), ((box[1] + box[3]) / 2).cast("float").alias("y"))
    known = {
        "object_type": col("target_kind"), "object_id": F.when(~group, target), "group_id": F.when(group, target), "group_size": F.when(group, col("size")),
        "instance_ids": col("instance_ids"), "expression_text": col("text"), "expression_type": col("expr_type"), "expression_id": col("pos"),
        "domain_name": col("domain"), "domain_id": F.try_element_at(ids, col("domain").cast("string")), "possible_colors": col("possible_colours"),
        "bbox": F.struct(*[F.coalesce(b, F.lit(0)).alias(n) for b, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)]),
        "area": (box[2] - box[0]) * (box[3] - box[1]), "centroid": F.when(centre["x"].isNotNull() & centre["y"].isNotNull(), centre),
        "rle_mask": F.struct(F.coalesce(mask["size"], F.array().cast("array<int>")).alias("size"), F.coalesce(mask["counts"], F.lit("")).alias("counts")),
    }
    cell = lambda n, kind: (F.coalesce(F.col(n).cast(kind), known[n].cast(kind)) if n in have and n in known and n != "object_id" else known[n].cast(kind) if n in known else col(n).cast(kind))
    return samples.select(*[F.coalesce(cell(n, kind), F.expr(default).cast(kind)).alias(n) for n, (kind, default) in SAMPLE.items()])


def export_samples(samples: DataFrame, path: str) -> None:
    published(samples).write.partitionBy("split").parquet(path)


def refcoco(exprs: DataFrame) -> DataFrame:
    """(split, patch_id, target_kind, target_id, sentences): a reference per target with its sentences in order."""
    cell = F.struct("pos", F.col("text").alias("sent"), F.col("expr_type").alias("type"))
    return exprs.groupBy("split", "patch_id", "target_kind", "target_id").agg(F.sort_array(F.collect_list(cell)).alias("sentences"))


def refcoco_summary(refs: DataFrame) -> DataFrame:
    return refs.groupBy("split").agg(F.count_distinct("patch_id").alias("images"), F.count("*").alias("refs"), F.sum(F.size("sentences")).alias("sentences"))


def export_refcoco(exprs: DataFrame, path: str) -> None:
    """References as JSON lines per split, and a summary beside them."""
    refs = refcoco(exprs)
    refs.write.partitionBy("split").json(f"{path}/refs")
    refcoco_summary(refs).coalesce(1).write.json(f"{path}/summary")


def export_chat(df: DataFrame, path: str, system: str, user: str, assistant: str) -> None:
    df.select(chat_line(system, F.col(user), F.col(assistant)).alias("value")).write.text(path)


def export_bundle(files: DataFrame, path: str, exclude: str | None = None, name: str = "name") -> None:
    """Final rows as Parquet per split, without names of one prefix if asked."""
    kept = files if exclude is None else files.filter(~F.startswith(F.col(name), F.lit(exclude)))
    kept.write.partitionBy("split").parquet(path)


def chat_line(system: str, user: Column, assistant: Column) -> Column:
    """{"messages": [system, user, assistant]} as JSON."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))
    return json_lines(F.struct(messages.alias("messages")))


def markdown_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, line): each row as a line of a Markdown table, key first."""
    cells = [F.col(key), *[F.col(x) for x in df.columns if x != key]]
    return df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Small tables, each as one CSV file in a folder of its name."""
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
