"""Queries of scans, sinks, matches and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.operators import enrichment as en
from groundphrase.operators import masks as ms
from groundphrase.operators import matching as ma
from groundphrase.operators import merging as mg
from groundphrase.operators import selection as se
from groundphrase.operators.lineage import scratch
from groundphrase.plans.registry import Registry
from groundphrase.sources import patch_files as pf
from groundphrase.sources import readers as rd
from groundphrase.sources import sinks as si

exchanging = Registry()
add = exchanging.add
c = F.col
exchanging.part("scenes", "SELECT patch_id AS image_id, 900 + patch_id % 7 * 100 AS width, 800 + patch_id % 5 * 90 AS height FROM (SELECT DISTINCT patch_id FROM objects) q")
exchanging.part("spots", "SELECT patch_id AS image_id, object_id, xmin * 3 AS xmin, ymin * 3 AS ymin, xmax * 3 AS xmax, ymax * 3 AS ymax FROM objects")
exchanging.part("cells", """SELECT s.*, w.ix, w.iy, w.ix * 384 AS x0, w.iy * 384 AS y0 FROM spots s JOIN scenes i ON s.image_id = i.image_id JOIN (SELECT ix, iy FROM range(6) a(ix), range(6) b(iy)) w
 ON w.ix * 384 + 480 <= i.width AND w.iy * 384 + 480 <= i.height AND s.xmin < w.ix * 384 + 480 AND s.xmax > w.ix * 384 AND s.ymin < w.iy * 384 + 480 AND s.ymax > w.iy * 384""")
exchanging.part("cut_cells", """SELECT *, greatest(xmin - x0, 0) AS l, greatest(ymin - y0, 0) AS t, least(xmax - x0, 480) AS r, least(ymax - y0, 480) AS b FROM cells""")


def scenes(o: DataFrame) -> DataFrame:
    return o.select("patch_id").distinct().selectExpr("patch_id AS image_id", "900 + patch_id % 7 * 100 AS width", "800 + patch_id % 5 * 90 AS height")


def spots(o: DataFrame) -> DataFrame:
    return o.selectExpr("patch_id AS image_id", "object_id", "xmin * 3 AS xmin", "ymin * 3 AS ymin", "xmax * 3 AS xmax", "ymax * 3 AS ymax")


# ---- windows and matches

@add("window_overlap", "objects", 'SELECT image_id, object_id, ix, iy, l AS "left", t AS top, r AS "right", b AS bottom, round((r - l) * (b - t) / CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE), 6) AS share FROM cut_cells')
def window_overlap(o: DataFrame) -> DataFrame:
    d = ma.assign_windows(scenes(o), spots(o))
    as_long = [c(k).cast("bigint").alias(k) for k in ("left", "top", "right", "bottom")]
    return d.select("image_id", "object_id", "ix", "iy", *as_long, F.round("share", 6).alias("share"))


exchanging.part("outlines", """SELECT patch_id AS image_id, object_id, xmin * 3 AS x, ymin * 3 AS y, xmax - xmin AS w, ymax - ymin AS h, CAST(4 + object_id % 60 AS BIGINT) AS v FROM objects""")
exchanging.part("columns_", """SELECT image_id, object_id, unnest(range(x, x + w + 1)) AS cx, y AS y0, y + h + 1 AS y1 FROM outlines UNION ALL
 SELECT image_id, object_id, cx, t, CAST(CASE WHEN cx = px THEN t + v ELSE greatest(floor(line), CASE WHEN w >= v THEN floor(line + 0.5) ELSE least(t + v, ceil(after) - 1) END) END AS BIGINT) + 1
 FROM (SELECT *, t + v + (cx - px) * CAST(-v AS DOUBLE) / -w AS line, t + v + (cx + 0.5 - px) * CAST(-v AS DOUBLE) / -w AS after FROM (SELECT *, x + 5 + w AS px, y + h - 3 AS t, unnest(range(x + 5, x + 6 + w)) AS cx FROM outlines) q) q""")
exchanging.part("window_runs", """SELECT c.image_id, object_id, ix, iy, (cx - ix * 384) * 480 + greatest(0, y0 - iy * 384) AS s, (cx - ix * 384) * 480 + least(480, least(y1, i.height) - iy * 384) AS e
 FROM columns_ c JOIN scenes i ON c.image_id = i.image_id JOIN (SELECT ix, iy FROM range(6) a(ix), range(6) b(iy)) w
 ON w.ix * 384 + 480 <= i.width AND w.iy * 384 + 480 <= i.height AND cx >= ix * 384 AND cx < ix * 384 + 480 AND y0 < iy * 384 + 480 AND least(y1, i.height) > iy * 384""")
exchanging.part("window_islands", """SELECT image_id, object_id, ix, iy, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s > before THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, object_id, ix, iy ORDER BY s, e) AS k FROM
 (SELECT *, coalesce(max(e) OVER (PARTITION BY image_id, object_id, ix, iy ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM window_runs) q) q GROUP BY image_id, object_id, ix, iy, k""")


@add("window_masks", "objects", """SELECT m.*, m.area / (o.w * o.h + o.w * o.v / 2.0) < 0.5 AND m.area < 500 AS is_cutoff FROM (SELECT image_id, object_id, ix, iy, CAST(sum(e - s) AS BIGINT) AS area,
 CAST(min(s // 480) AS INT) AS xmin, CAST(min(CASE WHEN s // 480 = (e - 1) // 480 THEN s % 480 ELSE 0 END) AS INT) AS ymin, CAST(max((e - 1) // 480) + 1 AS INT) AS xmax,
 CAST(max(CASE WHEN s // 480 = (e - 1) // 480 THEN (e - 1) % 480 + 1 ELSE 480 END) AS INT) AS ymax, string_agg(s || ':' || (e - s), ' ' ORDER BY s) AS runs FROM window_islands GROUP BY ALL) m JOIN outlines o ON o.object_id = m.object_id""")
def window_masks(o: DataFrame) -> DataFrame:
    """Masks of two polygons each, a rectangle and a triangle, in the windows of a scene."""
    at = o.selectExpr("patch_id AS image_id", "object_id", "xmin * 3 AS x", "ymin * 3 AS y", "xmax - xmin AS w", "ymax - ymin AS h", "CAST(4 + object_id % 60 AS BIGINT) AS v")
    right, low = c("x") + c("w") + 5, c("y") + c("h") - 3
    corners = lambda *p: F.array(*[(k + 0.75).cast("double") for k in p])
    boxes = corners(c("x"), c("y"), c("x") + c("w"), c("y"), c("x") + c("w"), c("y") + c("h"), c("x"), c("y") + c("h"))
    a = at.select("image_id", "object_id", F.array(boxes, corners(c("x") + 5, low, right, low, right, low + c("v"))).alias("segmentation"), (c("w") * c("h") + c("w") * c("v") / 2).alias("area"))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["length"])), " ")
    return ms.window_masks(scenes(o), a).withColumn("runs", said).drop("source_area")


@add("patch_yield", "objects", """SELECT image_id, possible, coalesce(h, 0) AS with_objects, possible - coalesce(h, 0) AS without FROM (SELECT image_id, CAST((floor((width - 480) / 384.0) + 1) * (floor((height - 480) / 384.0) + 1) AS BIGINT) AS possible FROM scenes) s
 LEFT JOIN (SELECT image_id, count(DISTINCT ix * 100 + iy) AS h FROM cut_cells WHERE (r - l) * (b - t) / CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) >= 0.5 GROUP BY image_id) q USING (image_id)""")
def patch_yield(o: DataFrame) -> DataFrame:
    return ma.patch_yield(scenes(o), spots(o))


@add("orphan_images", "files", r"SELECT DISTINCT stem FROM (SELECT *, regexp_extract(name, '^([^.]*)', 1) AS stem FROM files) q WHERE name LIKE '%.png' AND stem NOT IN (SELECT regexp_extract(name, '^([^.]*)', 1) FROM files WHERE name LIKE '%.xml')")
def orphan_images(f: DataFrame) -> DataFrame:
    d = f.withColumn("stem", F.regexp_extract("name", r"^([^.]*)", 1))
    return ma.orphan_images(d.filter(F.endswith("name", F.lit(".png"))), d.filter(F.endswith("name", F.lit(".xml")))).select("stem").distinct()


@add("pair_image_mask", "files", "SELECT a.file_id AS id FROM files a JOIN files b ON b.file_id = a.file_id AND a.file_id % 4 < 3 AND b.file_id % 3 < 2")
def pair_image_mask(f: DataFrame) -> DataFrame:
    images, masks = (f.filter(x).select(c("file_id").alias("id")) for x in ("file_id % 4 < 3", "file_id % 3 < 2"))
    return ma.pair_image_mask(images, masks)


@add("match_descriptions", "objects", "SELECT object_id, CASE WHEN pos < 12 THEN 'seen ' || pos ELSE 'the object in the image' END AS description FROM objects")
def match_descriptions(o: DataFrame) -> DataFrame:
    said = o.filter("pos < 12").select("patch_id", "xmin", "ymin", "xmax", "ymax", "pos", F.concat(F.lit("seen "), "pos").alias("description"))
    again = said.withColumns({"pos": c("pos") + 50, "description": F.lit("later")})
    return ma.match_descriptions(o.drop("pos"), said.unionByName(again), ["patch_id", "xmin", "ymin", "xmax", "ymax"]).select("object_id", "description")


@add("join_by_image", "objects files", "SELECT o.object_id, max(f.file_id) AS file_id FROM objects o JOIN files f ON floor(f.file_id / 20.0) = o.patch_id GROUP BY o.object_id")
def join_by_image(o: DataFrame, f: DataFrame) -> DataFrame:
    right = f.select(F.floor(c("file_id") / 20).alias("patch_id"), "file_id", "name")
    return ma.join_by_image(o.select("object_id", "patch_id"), right, "patch_id", "file_id").select("object_id", "file_id")


@add("box_descriptions", "objects exprs", "SELECT o.object_id, coalesce(e.text, 'the object in the image') AS description FROM objects o LEFT JOIN exprs e ON e.target_id = o.object_id AND e.pos = 2")
def box_descriptions(o: DataFrame, e: DataFrame) -> DataFrame:
    said = e.filter("pos >= 2").select(c("target_id").alias("object_id"), "pos", c("text").alias("description"))
    return ma.match_descriptions(o.select("object_id"), said, ["object_id"])


exchanging.part("listed", "SELECT patch_id AS ref_id, unnest([patch_id * 20 + 5, patch_id * 20 + 2, patch_id * 20 + 11, -1]) AS ann_id, unnest([0, 1, 2, 3]) AS n FROM (SELECT DISTINCT patch_id FROM objects) q")


@add("resolve_annotations", "objects", "SELECT l.ref_id, string_agg(o.object_id || ':' || o.category || ':' || o.xmin, ',' ORDER BY l.n) AS boxes FROM listed l JOIN objects o ON o.object_id = l.ann_id GROUP BY l.ref_id")
def resolve_annotations(o: DataFrame) -> DataFrame:
    refs = o.select("patch_id").distinct().selectExpr("patch_id AS ref_id", "array(patch_id * 20 + 5, patch_id * 20 + 2, patch_id * 20 + 11, -1) AS ann_ids")
    found = ma.resolve_annotations(refs, o.withColumnRenamed("object_id", "ann_id"))
    return found.select("ref_id", F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b["ann_id"], b["category"], b["xmin"])), ",").alias("boxes"))


@add("browse_refs", "exprs objects nation", "SELECT e.target_id * 10 + e.pos AS ref_id, o.object_id AS ann_id, n.n_name AS category_name, e.text AS sentence, o.xmin, o.ymin FROM exprs e JOIN objects o ON o.object_id = e.target_id JOIN nation n ON n.n_nationkey = o.object_id % 25")
def browse_refs(e: DataFrame, o: DataFrame, n: DataFrame) -> DataFrame:
    refs = e.select((c("target_id") * 10 + c("pos")).alias("ref_id"), c("target_id").alias("ann_id"), c("text").alias("sentence"))
    anns = o.select(c("object_id").alias("ann_id"), (c("object_id") % 25).cast("int").alias("category_id"), "xmin", "ymin")
    return ma.browse_refs(refs, anns, n.select(c("n_nationkey").alias("category_id"), c("n_name").alias("category_name")))


@add("add_missing_class_group", "objects pixels", """SELECT patch_id, object_id AS group_id, category FROM objects WHERE pos < 3 UNION ALL SELECT p.image_id, coalesce((SELECT max(object_id) FROM objects o WHERE o.patch_id = p.image_id AND o.pos < 3), -1) + 1, 'ship'
 FROM (SELECT DISTINCT image_id FROM pixels WHERE class_id = 2) p WHERE p.image_id NOT IN (SELECT patch_id FROM objects WHERE pos < 3 AND category = 'ship')""")
def add_missing_class_group(o: DataFrame, x: DataFrame) -> DataFrame:
    groups = o.filter("pos < 3").select("patch_id", c("object_id").alias("group_id"), "category")
    return ma.add_missing_class_group(groups, x.filter("class_id = 2").select(c("image_id").alias("patch_id")), "ship")


# ---- scans

@add("scan_coco_explode", "objects", "SELECT object_id AS id, patch_id AS image_id, category AS category_name, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM objects")
def scan_coco_explode(o: DataFrame) -> DataFrame:
    """Each patch as one COCO document, parsed again."""
    box = F.array(*[x.cast("double") for x in (c("xmin"), c("ymin"), c("xmax") - c("xmin"), c("ymax") - c("ymin"))])
    a = F.struct(c("object_id").alias("id"), c("patch_id").alias("image_id"), c("category").alias("category_name"), box.alias("bbox"))
    docs = o.groupBy("patch_id").agg(F.collect_list(a).alias("annotations")).select(F.to_json(F.struct("annotations", F.array(F.struct(c("patch_id").alias("id"))).alias("images"))).alias("j"))
    _, anns = rd.explode_coco(docs.select(F.from_json("j", rd.COCO).alias("d")).select("d.*"))
    return anns.select("id", "image_id", "category_name", "xmin", "ymin", "xmax", "ymax")


@add("scan_coco_blocks", "objects", "SELECT object_id AS id, patch_id AS image_id, category AS category_name, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM objects")
def scan_coco_blocks(o: DataFrame) -> DataFrame:
    """Documents of many patches each, written as files and read again by blocks that end anywhere."""
    box = F.array(*[x.cast("double") for x in (c("xmin"), c("ymin"), c("xmax") - c("xmin"), c("ymax") - c("ymin"))])
    a = F.struct(c("object_id").alias("id"), c("patch_id").alias("image_id"), c("category").alias("category_name"), box.alias("bbox"), F.array(F.array(c("xmin"), c("ymin"))).alias("segmentation"))
    docs = o.groupBy(F.floor(c("patch_id") / 50)).agg(F.collect_list(a).alias("annotations"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit("}{").alias("file_name"))).alias("images"), "annotations"))
    path = scratch(o.sparkSession, "coco")
    docs.select(text).write.text(path)
    return rd.read_coco_blocks(o.sparkSession, path)[1].select("id", "image_id", "category_name", "xmin", "ymin", "xmax", "ymax")


def documents_of(o: DataFrame) -> DataFrame:
    patches = o.select("patch_id").distinct().select("patch_id", F.concat(F.lit("P"), "patch_id", F.lit(".png")).alias("filename"), F.lit(480).alias("width"), F.lit(480).alias("height"))
    return si.annotation_documents(patches, o)


@add("xml_documents", "objects", "SELECT patch_id, 'P' || patch_id || '.png' AS filename, count(*) AS n, min(object_id) AS first_id FROM objects GROUP BY patch_id")
def xml_documents(o: DataFrame) -> DataFrame:
    return documents_of(o).select("patch_id", "filename", F.size("object").cast("bigint").alias("n"), F.array_min(c("object")["id"]).alias("first_id"))


def tables_of(e: DataFrame, o: DataFrame) -> dict[str, DataFrame]:
    """Objects, groups and phrases under the names of their patches' files."""
    name = F.concat(F.lit("P"), "patch_id", F.lit(".png")).alias("filename")
    patches = o.select("patch_id").distinct().select(name, F.lit(480).alias("width"), F.lit(480).alias("height"))
    said = e.select(name, "target_kind", "target_id", "pos", "expr_type", "text", (c("pos") % 3 == 1).alias("is_dummy"))
    objects = o.select(name, "*").withColumn("mask", F.concat(F.lit("m"), "object_id"))
    return {"patches": patches, "objects": objects, "groups": groups_of(e, o).select(name, "*"), "expressions": said}


@add("xml_expressions", "exprs objects", """SELECT 'P' || e.patch_id || '.png' AS filename, e.target_kind, e.target_id, e.pos, e.expr_type, e.text, e.pos % 3 = 1 AS is_dummy FROM exprs e
 WHERE e.target_kind = 'group' AND EXISTS (SELECT 1 FROM objects g WHERE g.patch_id = e.patch_id AND g.pos < 5) OR e.target_kind = 'individual' AND e.target_id IN (SELECT object_id FROM objects)""")
def xml_expressions(e: DataFrame, o: DataFrame) -> DataFrame:
    """Phrases of objects and groups, written as XML documents and parsed again."""
    docs = si.full_documents(tables_of(e, o))
    text = docs.select(F.to_xml(F.struct(*docs.columns), {"rowTag": "annotation"}).alias("t"))
    return rd.explode_documents(text.select(F.from_xml("t", rd.FULL).alias("d")).select("d.*"))["expressions"].withColumn("pos", c("pos").cast("int"))


@add("scan_xml_objects", "objects", "SELECT 'P' || patch_id || '.png' AS filename, object_id, category, xmin, ymin, xmax, ymax, is_cutoff FROM objects")
def scan_xml_objects(o: DataFrame) -> DataFrame:
    """Each patch as an XML document, parsed again."""
    text = documents_of(o).select(F.to_xml(F.struct("filename", "width", "height", "object"), {"rowTag": "annotation"}).alias("t"))
    return rd.explode_annotations(text.select(F.from_xml("t", rd.ANNOTATION).alias("d")).select("d.*"))


@add("sample_patch_files", "objects", """SELECT 'P' || patch_id || '.png' AS filename, object_id, category, xmin, ymax FROM objects WHERE patch_id IN
 (SELECT patch_id FROM (SELECT DISTINCT patch_id FROM objects) q ORDER BY patch_id * 7919 % 1009, 'P' || patch_id || '.xml' LIMIT 100)""")
def sample_patch_files(o: DataFrame) -> DataFrame:
    """A file a patch; of their listing 100 files are chosen, and only these are parsed."""
    spark, path = o.sparkSession, scratch(o.sparkSession, "patches")
    pf.write_patch_files(documents_of(o).drop("patch_id"), path)
    number = F.regexp_extract("name", r"^P(\d+)\.", 1).cast("bigint")
    chosen = pf.sample_files(pf.list_files(spark, path), 100, order=number * 7919 % 1009)
    return rd.explode_documents(pf.read_chosen(spark, chosen))["objects"].select("filename", "object_id", "category", "xmin", "ymax")


exchanging.part("first_five", "SELECT patch_id, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM objects WHERE pos < 5 GROUP BY patch_id")


def groups_of(e: DataFrame, o: DataFrame) -> DataFrame:
    """The group targets of the phrases; the first five objects of a patch stand for their members."""
    members = o.filter("pos < 5").groupBy("patch_id").agg(F.sort_array(F.collect_list("object_id")).alias("instance_ids"))
    return e.filter("target_kind = 'group'").select("patch_id", c("target_id").alias("group_id")).distinct().join(members, "patch_id")


@add("samples_from_annotations", "exprs objects", """SELECT e.patch_id, e.target_id, e.pos, e.text, o.category, coalesce(o.xmin, g.xmin) AS xmin, coalesce(o.ymax, g.ymax) AS ymax, 'm' || o.object_id AS mask FROM exprs e
 LEFT JOIN objects o ON e.target_kind = 'individual' AND o.object_id = e.target_id LEFT JOIN first_five g ON e.target_kind = 'group' AND g.patch_id = e.patch_id""")
def samples_from_annotations(e: DataFrame, o: DataFrame) -> DataFrame:
    masked = o.withColumn("mask", F.concat(F.lit("m"), "object_id"))
    return ma.samples(e, masked, groups_of(e, o)).select("patch_id", "target_id", "pos", "text", "category", "xmin", "ymax", "mask")


@add("described_boxes", "objects", """SELECT patch_id AS image_id, CASE WHEN patch_id % 3 = 0 THEN 'the object in the image' ELSE 'box ' || object_id END AS description,
 (xmin + CASE WHEN patch_id % 3 = 0 THEN 1 ELSE 0 END) || ',' || ymin || ',' || xmax || ',' || ymax AS bbox, 'mask ' || object_id AS segmentation FROM objects o WHERE patch_id % 2 = 0
 AND object_id = (SELECT max(object_id) FROM objects l WHERE l.patch_id = o.patch_id)""")
def described_boxes(o: DataFrame) -> DataFrame:
    """Each patch as a document and an annotation file of its own; the last object's box counts, moved where patch_id % 3 = 0."""
    thing = F.struct(F.struct("xmin", "ymin", "xmax", "ymax").alias("bndbox"), F.concat(F.lit("box "), "object_id").alias("description"))
    docs = o.groupBy("patch_id").agg(F.collect_list(thing).alias("object"))
    docs = docs.select(c("patch_id").alias("image_id"), F.when(c("patch_id") % 2 == 0, "val").otherwise("train").alias("split"), "object")
    box = F.array(c("xmin") + (c("patch_id") % 3 == 0).cast("int"), "ymin", "xmax", "ymax")
    a = F.struct("object_id", c("patch_id").alias("image_id"), box.alias("bbox"), F.array(F.concat(F.lit("mask "), "object_id"), F.lit("no")).alias("segmentation"))
    files = o.groupBy("patch_id").agg(F.sort_array(F.collect_list(a)).alias("annotations")).select(F.to_json(F.struct("annotations")).alias("j"))
    parsed = files.select(F.from_json("j", rd.MASKED).alias("d")).select("d.*")
    return ma.described_boxes(docs, parsed, "val").withColumn("bbox", F.array_join(c("bbox").cast("array<string>"), ","))


@add("scan_landcover_paths", "files", "SELECT file_id, split, left(name, 1) AS domain, 'masks' AS kind, regexp_extract(name, '^([^.]*)', 1) AS id FROM files WHERE name LIKE '%.png'")
def scan_landcover_paths(f: DataFrame) -> DataFrame:
    path = F.concat_ws("/", F.lit("file:/x"), "split", F.substring("name", 1, 1), F.lit("masks_png"), "name")
    return f.filter(F.endswith("name", F.lit(".png"))).select("file_id", *rd.landcover_path(path))


@add("scan_phrase_list", "exprs", "SELECT target_id AS image_id, text AS phrase FROM exprs WHERE target_id % 9 > 1")
def scan_phrase_list(e: DataFrame) -> DataFrame:
    line = F.when(c("target_id") % 9 == 0, F.lit("no number here")).when(c("target_id") % 9 == 1, F.concat(c("target_id"), F.lit("  "))).otherwise(F.concat_ws(" ", "target_id", "text"))
    return rd.phrase_lines(e.select(line.alias("value")))


@add("scan_refs", "exprs", "SELECT patch_id AS ref_id, CAST(row_number() OVER (PARTITION BY patch_id ORDER BY target_id, pos) - 1 AS INT) AS n, text AS sentence FROM exprs")
def scan_refs(e: DataFrame) -> DataFrame:
    s = F.sort_array(F.collect_list(F.struct("target_id", "pos", "text")))
    ref = F.struct(c("patch_id").alias("ref_id"), F.transform("s", lambda x: F.struct(x["text"].alias("sent"))).alias("sentences"))
    docs = e.groupBy("patch_id").agg(s.alias("s")).select(F.to_json(F.struct(F.array(ref).alias("refs"))).alias("j"))
    return rd.explode_refs(docs.select(F.from_json("j", rd.REFS).alias("d")).select("d.*")).select("ref_id", "n", "sentence")


@add("scan_split_lists", "files", r"SELECT regexp_replace(name, '\.png$', '') AS name, split FROM files")
def scan_split_lists(f: DataFrame) -> DataFrame:
    return rd.split_lines(f.select(F.concat(F.lit(" "), "name", F.lit(" ")).alias("value"), F.concat(F.lit("x/labelled_"), "split", F.lit(".txt")).alias("p")), c("p"))


@add("style_bank_roundtrip", "pixels", "SELECT CASE WHEN image_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, round(avg(m), 4) AS mean_b, count(*) AS num_images FROM (SELECT image_id, avg(b) AS m FROM pixels GROUP BY image_id) q GROUP BY ALL")
def style_bank_roundtrip(x: DataFrame) -> DataFrame:
    from groundphrase.plans.pictures import bank_of

    row = F.struct("domain", F.array("m_b", "m_g", "m_r").alias("rgb_mean"), F.array("s_b", "s_g", "s_r").alias("rgb_std"), "num_images")
    back = bank_of(x).select(F.from_json(F.to_json(row), rd.BANK).alias("d"))
    return back.select("d.domain", F.round(c("d.rgb_mean")[0], 4).alias("mean_b"), "d.num_images")


@add("scan_llm_results", "responses", "SELECT conv_id, count(*) FILTER (WHERE conv_id % 5 <> 0) AS parsed, count(*) FILTER (WHERE conv_id % 5 = 0) AS rejected FROM responses GROUP BY conv_id")
def scan_llm_results(x: DataFrame) -> DataFrame:
    good, bad = en.split_replies(x, "raw")
    both = good.select("conv_id", F.lit(1).alias("g")).unionByName(bad.select("conv_id", F.lit(0).alias("g")))
    return both.groupBy("conv_id").agg(F.count_if(c("g") == 1).alias("parsed"), F.count_if(c("g") == 0).alias("rejected"))


@add("scan_result_dir", "responses", "SELECT conv_id, count(*) AS n FROM responses WHERE conv_id % 5 > 2 GROUP BY conv_id")
def scan_result_dir(x: DataFrame) -> DataFrame:
    """Whole texts as single JSON results, those that are nothing but JSON."""
    d = x.select("conv_id", F.from_json("raw", en.REPLY).alias("d")).filter("d.enhanced_expressions is not null")
    return d.groupBy("conv_id").agg(F.count("*").alias("n"))


@add("compile_run_metrics", "objects", "SELECT object_id, concat_ws('|', category, xmin, ymin, xmax, CASE WHEN pos % 2 = 0 THEN ymax ELSE object_id END) AS lines FROM objects")
def compile_run_metrics(o: DataFrame) -> DataFrame:
    """An object's values as a run's metrics file, with blank lines, and more lines than count."""
    last = F.when(c("pos") % 2 == 0, c("ymax").cast("string")).otherwise("  ")
    text = F.concat_ws("\n", "category", F.lit(""), "xmin", F.lit("  "), "ymin", "xmax", last, "object_id", F.lit("end"), F.lit(""))
    return rd.metric_lines(o.select("object_id", text.alias("value")), c("object_id")).select(c("run").alias("object_id"), F.array_join("lines", "|").alias("lines"))


# ---- sinks

@add("llm_request_json", "exprs", "SELECT split, count(*) AS n FROM (SELECT DISTINCT split, patch_id, target_id FROM exprs) q GROUP BY split")
def llm_request_json(e: DataFrame) -> DataFrame:
    return requests(e).filter(F.get_json_object("value", "$.request.contents[0].role") == "user").groupBy("split").agg(F.count("*").alias("n"))


def requests(e: DataFrame) -> DataFrame:
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    t = e.groupBy("split", "patch_id", "target_id").agg(said.alias("phrases"))
    return en.build_request(t, F.concat(F.lit("store/P"), "patch_id", F.lit("_object_"), "target_id", F.lit(".png")))


@add("build_request", "exprs", f"SELECT split, '{en.INSTRUCTION}' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY pos) AS prompt, 'store/P' || patch_id || '_object_' || target_id || '.png' AS uri FROM exprs GROUP BY split, patch_id, target_id")
def build_request(e: DataFrame) -> DataFrame:
    part = lambda p: F.get_json_object("value", f"$.request.contents[0].parts[{p}")
    return requests(e).select("split", part("0].text").alias("prompt"), part("1].fileUri").alias("uri"))


@add("refcoco_counts", "exprs", "SELECT split, count(DISTINCT patch_id) AS images, count(DISTINCT patch_id || '/' || target_id) AS refs, count(*) AS sentences FROM exprs GROUP BY split")
def refcoco_counts(e: DataFrame) -> DataFrame:
    """The nested export of references, counted."""
    return si.refcoco_summary(si.refcoco(e))


@add("export_samples", "exprs objects", """SELECT CAST(e.pos AS VARCHAR) AS expression_id, e.split, CASE WHEN e.patch_id % 2 = 0 THEN 'iSAID' ELSE 'Unknown' END AS domain_name, CASE WHEN e.patch_id % 2 = 0 THEN 0 ELSE -1 END AS domain_id,
 e.text AS expression_text, e.target_kind AS object_type, CASE WHEN e.target_kind = 'group' THEN '' ELSE CAST(e.target_id AS VARCHAR) END AS object_id, CASE WHEN e.target_kind = 'group' THEN CAST(e.target_id AS VARCHAR) ELSE '' END AS group_id,
 coalesce(o.category, '') AS category, coalesce(o.xmin, g.xmin, 0) AS xmin, coalesce(o.ymax, g.ymax, 0) AS ymax, coalesce((o.xmax - o.xmin) * (o.ymax - o.ymin), (g.xmax - g.xmin) * (g.ymax - g.ymin), 0) AS area,
 CASE WHEN o.object_id IS NOT NULL THEN 'c' || o.object_id ELSE '' END AS counts, CAST(CASE WHEN g.patch_id IS NOT NULL THEN g.n ELSE 0 END AS BIGINT) AS members, coalesce((o.xmin + o.xmax) / 2.0, (g.xmin + g.xmax) / 2.0, 0) AS cx
 FROM exprs e LEFT JOIN objects o ON e.target_kind = 'individual' AND o.object_id = e.target_id LEFT JOIN (SELECT f.*, k.n FROM first_five f JOIN (SELECT patch_id, count(*) AS n FROM objects WHERE pos < 5 GROUP BY patch_id) k ON k.patch_id = f.patch_id) g
 ON e.target_kind = 'group' AND g.patch_id = e.patch_id""")
def export_samples(e: DataFrame, o: DataFrame) -> DataFrame:
    masked = o.withColumn("mask", F.concat(F.lit('{"size":[480,480],"counts":"c'), "object_id", F.lit('"}')))
    told = ma.samples(e, masked, groups_of(e, o)).withColumn("domain", F.when(c("patch_id") % 2 == 0, "iSAID"))
    return si.published(told).select(
        "expression_id", "split", "domain_name", "domain_id", "expression_text", "object_type", "object_id", "group_id", "category", "bbox.xmin", "bbox.ymax", "area",
        "rle_mask.counts", F.size("instance_ids").cast("bigint").alias("members"), c("centroid.x").cast("double").alias("cx"),
    )


@add("chat_jsonl", "exprs", """SELECT target_id, pos, '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"' || text || '"},{"role":"assistant","content":"' || expr_type || '"}]}' AS line FROM exprs""")
def chat_jsonl(e: DataFrame) -> DataFrame:
    return e.select("target_id", "pos", si.chat_line("s", c("text"), c("expr_type")).alias("line"))


@add("export_bundle_manifest", "files", "SELECT split, count(*) AS n, min(name) AS first_name FROM files WHERE NOT starts_with(name, 'D') GROUP BY split")
def export_bundle_manifest(f: DataFrame) -> DataFrame:
    return se.exclude_prefix(f, "D").groupBy("split").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


# ---- replies

@add("recover_json", "responses", "SELECT conv_id, turn, 'boat ' || turn AS variation FROM responses WHERE conv_id % 5 <> 0")
def recover_json(x: DataFrame) -> DataFrame:
    d = x.withColumn("reply", en.recover_json(c("raw"))).filter("reply is not null")
    return d.select("conv_id", "turn", c("reply.enhanced_expressions")[0]["variation"].alias("variation"))


exchanging.part("boats", """SELECT conv_id * 100 + turn AS id, 'enhanced' AS expr_type, 0 AS j, 'the ship' AS original, 'boat ' || turn AS text FROM responses WHERE conv_id % 5 <> 0
 UNION ALL SELECT conv_id * 100 + turn, 'unique', 0, NULL, 'a' || conv_id FROM responses WHERE conv_id % 5 <> 0""")


@add("explode_response", "responses", "SELECT id, expr_type, id || '_var_' || j AS variant, original, text FROM boats")
def explode_response(x: DataFrame) -> DataFrame:
    good, _ = en.split_replies(x.withColumn("id", c("conv_id") * 100 + c("turn")), "raw")
    return en.explode_response(good, "id")


@add("attach_llm_results", "exprs", """SELECT e.patch_id * 1000 + e.target_id AS key, e.pos AS result_pos, q.pos FROM exprs e JOIN (SELECT a.patch_id, a.target_id, a.pos AS r, b.pos, row_number() OVER (PARTITION BY a.patch_id, a.target_id, a.pos
 ORDER BY CASE WHEN b.text = a.o THEN 0 ELSE 1 END, abs(length(b.text) - length(a.o)), b.pos) AS n FROM (SELECT *, CASE WHEN pos = 0 THEN text ELSE left(text, 12 + pos) END AS o FROM exprs) a JOIN exprs b ON a.patch_id = b.patch_id AND a.target_id = b.target_id) q
 ON q.patch_id = e.patch_id AND q.target_id = e.target_id AND q.r = e.pos AND q.n = 1""")
def attach_llm_results(e: DataFrame) -> DataFrame:
    d = e.withColumn("key", c("patch_id") * 1000 + c("target_id"))
    shown = F.when(c("pos") == 0, c("text")).otherwise(F.expr("left(text, 12 + pos)"))
    return en.attach_llm_results(d, d.select("key", c("pos").alias("result_pos"), shown.alias("original"), "text"))


exchanging.part("told", "SELECT patch_id, target_kind, target_id, max(CASE WHEN pos = 0 THEN text END) AS a, max(CASE WHEN pos = 1 THEN text END) AS b FROM exprs GROUP BY ALL")
exchanging.part("last_rounds", "SELECT *, CASE WHEN target_id % 6 = 0 THEN 2 ELSE 1 END AS round FROM told WHERE target_id % 3 = 0")
exchanging.part("variants", """SELECT patch_id, target_kind, target_id, 0 AS item, a AS said, 'v' || round || '_' || target_id AS text FROM last_rounds
 UNION ALL SELECT patch_id, target_kind, target_id, 1, left(b, CAST(5 + target_id % 60 AS INT)), 'w' || round || '_' || target_id FROM last_rounds""")
exchanging.part("variant_bases", """SELECT v.*, e.pos AS base, row_number() OVER (PARTITION BY v.patch_id, v.target_kind, v.target_id, v.item ORDER BY CASE WHEN e.text = v.said THEN 0 ELSE 1 END, abs(length(e.text) - length(v.said)), e.pos) AS n
 FROM variants v JOIN exprs e ON e.patch_id = v.patch_id AND e.target_kind = v.target_kind AND e.target_id = v.target_id AND e.expr_type = 'original'""")


def replies_to(e: DataFrame) -> DataFrame:
    """Replies to every third target, two to every sixth: a variant of its first phrase, one of a text that is cut off, blanks,
    and two unique phrases."""
    key = ["patch_id", "target_kind", "target_id"]
    told = e.groupBy(*key).agg(*[F.max(F.when(c("pos") == p, c("text"))).alias(n) for p, n in ((0, "a"), (1, "b"))]).filter("target_id % 3 = 0")
    d = told.withColumn("round", F.explode(F.when(c("target_id") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    named = lambda x: F.concat(F.lit(x), "round", F.lit("_"), "target_id")
    pair = lambda original, text: F.struct(original.alias("original_expression"), text.alias("variation"))
    items = F.array(pair(c("a"), named("v")), pair(F.expr("left(b, CAST(5 + target_id % 60 AS INT))"), named("w")), pair(c("a"), F.lit(" ")))
    unique = F.array(named("u"), F.lit(" "), named("z"))
    return d.select(*key, "round", F.struct(items.alias("enhanced_expressions"), F.lit(None).cast("string").alias("unique_description"), unique.alias("unique_expressions")).alias("reply"))


@add("merge_llm_results", "exprs", """SELECT patch_id, target_kind, target_id, pos, expr_type, text, CAST(pos AS VARCHAR) AS expr_id, NULL AS base_id, split FROM exprs WHERE expr_type = 'original' OR target_id % 3 <> 0
 UNION ALL SELECT v.patch_id, v.target_kind, v.target_id, v.item + 2, 'enhanced', v.text, v.base || '_var_' || (row_number() OVER (PARTITION BY v.patch_id, v.target_kind, v.target_id, v.base ORDER BY v.item) - 1), CAST(v.base AS VARCHAR), s.split
 FROM variant_bases v JOIN exprs s ON s.patch_id = v.patch_id AND s.target_kind = v.target_kind AND s.target_id = v.target_id AND s.pos = 0 WHERE v.n = 1
 UNION ALL SELECT r.patch_id, r.target_kind, r.target_id, k.p, 'unique', k.l || r.round || '_' || r.target_id, 'unique_' || k.i, NULL, s.split FROM last_rounds r JOIN exprs s ON s.patch_id = r.patch_id AND s.target_kind = r.target_kind AND s.target_id = r.target_id AND s.pos = 0
 CROSS JOIN (VALUES (4, 'u', 0), (5, 'z', 2)) k(p, l, i)""")
def merge_llm_results(e: DataFrame) -> DataFrame:
    return mg.merge_replies(e, replies_to(e), order="round")


@add("unpivot_translations", "customer", "SELECT c_custkey, 'pt' AS language, 'p' || c_name AS text FROM customer UNION ALL SELECT c_custkey, 'de', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def unpivot_translations(t: DataFrame) -> DataFrame:
    d = t.select("c_custkey", F.concat(F.lit("p"), "c_name").alias("pt"), F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")).alias("de"))
    return en.unpivot_translations(d, "c_custkey", ["pt", "de"])
