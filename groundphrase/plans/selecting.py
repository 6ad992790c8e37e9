"""Queries of filters, samples, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.functions import phrases as p
from groundphrase.operators import selection as s
from groundphrase.plans.registry import Registry

selecting = Registry()
add = selecting.add
c = F.col
#: In place of a hash, arithmetic that both engines do alike.
SQL_MIX = "(file_id * 7919 + 13) % 10007"
_DOMAIN = "CASE left(name, 1) WHEN 'P' THEN 'iSAID' WHEN 'L' THEN 'LoveDA' WHEN 'D' THEN 'DeepGlobe' ELSE 'Unknown' END"
selecting.part("named", f"SELECT *, {_DOMAIN} AS domain FROM files")


def named(f: DataFrame) -> DataFrame:
    return f.withColumn("domain", p.domain_of(c("name")))


@add("filter_id_range", "files", "SELECT file_id, name FROM files WHERE file_id >= 100 AND file_id <= 5000")
def filter_id_range(f: DataFrame) -> DataFrame:
    return s.filter_id_range(f, "file_id", 100, 5000).select("file_id", "name")


@add("sample_n_per_split", "files", f"SELECT file_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {SQL_MIX}, file_id) AS n FROM files) q WHERE n <= 50")
def sample_n_per_split(f: DataFrame) -> DataFrame:
    return s.sample_n(f, 50, "split", "file_id", F.expr(SQL_MIX)).select("file_id", "split")


@add("sample_pct_per_split", "files", f"SELECT file_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {SQL_MIX}, file_id) AS n, count(*) OVER (PARTITION BY split) AS m FROM files) q WHERE n <= floor(m * 12.5 / 100)")
def sample_pct_per_split(f: DataFrame) -> DataFrame:
    return s.sample_pct(f, 12.5, "split", "file_id", F.expr(SQL_MIX)).select("file_id", "split")


@add("filter_min_size", "objects", "SELECT object_id FROM objects WHERE xmax - xmin >= 20 AND ymax - ymin >= 20")
def filter_min_size(o: DataFrame) -> DataFrame:
    return s.filter_min_size(o.withColumns({"width": c("xmax") - c("xmin"), "height": c("ymax") - c("ymin")}), 20).select("object_id")


@add("filter_too_black", "pixels", "SELECT image_id, round(avg(CASE WHEN floor((114 * b + 587 * g + 299 * r + 500) / 1000.0) < 110 THEN 1 ELSE 0 END), 6) AS black_share FROM pixels GROUP BY image_id HAVING avg(CASE WHEN floor((114 * b + 587 * g + 299 * r + 500) / 1000.0) < 110 THEN 1 ELSE 0 END) <= 0.5")
def filter_too_black(x: DataFrame) -> DataFrame:
    return s.filter_too_black(x, 0.5, 110).withColumn("black_share", F.round("black_share", 6))


@add("split_ratio", "files", f"SELECT file_id, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY split) * 0.8) THEN 'train' ELSE 'val' END AS part FROM files WINDOW w AS (PARTITION BY split ORDER BY {SQL_MIX}, file_id)")
def split_ratio(f: DataFrame) -> DataFrame:
    return s.split_ratio(f, 0.8, "file_id", F.expr(SQL_MIX), c("split")).select("file_id", c("split").alias("part"))


@add("domain_counts", "files", "SELECT domain, split, count(*) AS n FROM named GROUP BY domain, split")
def domain_counts(f: DataFrame) -> DataFrame:
    return named(f).groupBy("domain", "split").agg(F.count("*").alias("n"))


@add("filter_domain", "files", "SELECT file_id FROM named WHERE domain = 'LoveDA'")
def filter_domain(f: DataFrame) -> DataFrame:
    return s.filter_domain(named(f), "LoveDA").select("file_id")


@add("expr_type_counts", "exprs", "SELECT expr_type AS kind, count(*) AS n FROM exprs GROUP BY expr_type")
def expr_type_counts(e: DataFrame) -> DataFrame:
    raw = e.withColumns({"_type": F.when(c("expr_type") == "unique", "unique"), "_id": F.when(c("expr_type") == "enhanced", c("target_id"))})
    return raw.groupBy(s.expr_type().alias("kind")).agg(F.count("*").alias("n"))


@add("filter_expr_type", "exprs", "SELECT target_id, pos FROM exprs WHERE expr_type = 'unique'")
def filter_expr_type(e: DataFrame) -> DataFrame:
    return s.filter_expr_type(e, unique=True).select("target_id", "pos")


@add("one_unique_per_target", "exprs", "SELECT patch_id, target_id, min(pos) AS pos FROM exprs WHERE expr_type = 'unique' GROUP BY patch_id, target_kind, target_id")
def one_unique_per_target(e: DataFrame) -> DataFrame:
    return s.one_per_target(e).select("patch_id", "target_id", "pos")


@add("filter_targets", "exprs", "SELECT 'class' AS mode, count(*) AS n FROM exprs WHERE target_id >= 1000000 AND target_id < 2000000 UNION ALL SELECT 'individual', count(*) FROM exprs WHERE target_kind = 'individual' UNION ALL SELECT 'all', count(*) FROM exprs")
def filter_targets(e: DataFrame) -> DataFrame:
    n = lambda m: s.filter_targets(e, m).agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n")
    return n("class").unionByName(n("individual")).unionByName(n("all"))


@add("drop_cutoff", "exprs objects", "SELECT target_id, pos FROM exprs WHERE target_id NOT IN (SELECT object_id FROM objects WHERE is_cutoff)")
def drop_cutoff(e: DataFrame, o: DataFrame) -> DataFrame:
    return s.drop_cutoff(e, o).select("target_id", "pos")


@add("drop_empty_targets", "objects exprs", "SELECT object_id FROM objects WHERE object_id IN (SELECT target_id FROM exprs WHERE expr_type = 'unique' AND text LIKE '%group of 2%')")
def drop_empty_targets(o: DataFrame, e: DataFrame) -> DataFrame:
    left = e.filter("expr_type = 'unique' and text like '%group of 2%'").select(c("target_id").alias("object_id"))
    return s.drop_empty_targets(o, left, ["object_id"]).select("object_id")


@add("clean_columns", "objects", "SELECT object_id, patch_id, category, xmin, ymin, xmax, ymax FROM objects")
def clean_columns(o: DataFrame) -> DataFrame:
    return s.clean_columns(o, ["object_id", "patch_id", "category", "xmin", "ymin", "xmax", "ymax", "not_there"])


@add("pending_targets", "exprs", "SELECT patch_id FROM (SELECT patch_id, bool_or(expr_type = 'enhanced') AND bool_or(expr_type = 'unique') AS d FROM exprs WHERE target_id % 17 <> 0 OR expr_type <> 'unique' GROUP BY patch_id, target_kind, target_id) q GROUP BY patch_id HAVING NOT bool_and(d)")
def pending_targets(e: DataFrame) -> DataFrame:
    return s.pending_targets(e.filter("target_id % 17 <> 0 or expr_type <> 'unique'"))


@add("reset_enrichment", "exprs", "SELECT expr_type, count(*) AS n FROM exprs WHERE expr_type = 'original' GROUP BY expr_type")
def reset_enrichment(e: DataFrame) -> DataFrame:
    return s.reset_enrichment(e).groupBy("expr_type").agg(F.count("*").alias("n"))


@add("purge_plan", "files", r"SELECT regexp_extract(name, '\.([^.]+)$', 1) AS kind, count(*) AS n FROM files WHERE regexp_matches(name, '_to[PDL]\.') GROUP BY ALL")
def purge_plan(f: DataFrame) -> DataFrame:
    return s.purge_plan(f, r"_to[PDL]\.")


@add("exclude_prefix", "files", "SELECT file_id FROM files WHERE NOT starts_with(name, 'D')")
def exclude_prefix(f: DataFrame) -> DataFrame:
    return s.exclude_prefix(f, "D").select("file_id")


@add("filter_components", "objects", """SELECT object_id FROM (SELECT object_id, CASE WHEN category IN ('building', 'ship') THEN 'building' WHEN category = 'plane' THEN 'water' ELSE 'road' END AS k,
 (xmax - xmin) * (ymax - ymin) AS area, (xmax - xmin) / CAST(ymax - ymin AS DOUBLE) AS aspect, (object_id % 10) / 10.0 AS solidity FROM objects) q
 WHERE k = 'building' AND area BETWEEN 100 AND 50000 AND aspect BETWEEN 0.1 AND 10 AND solidity >= 0.3 OR k = 'water' AND area BETWEEN 200 AND 200000 OR k = 'road' AND area BETWEEN 300 AND 1000000""")
def filter_components(o: DataFrame) -> DataFrame:
    rows = o.selectExpr("object_id", "CASE WHEN category IN ('building', 'ship') THEN 'building' WHEN category = 'plane' THEN 'water' ELSE 'road' END AS category",
                        "(xmax - xmin) * (ymax - ymin) AS area", "(xmax - xmin) / (ymax - ymin) AS aspect", "(object_id % 10) / 10 AS solidity")
    return s.filter_components(rows).select("object_id")


@add("filter_class_area", "pixels", "SELECT image_id, class_id, count(*) AS n FROM pixels GROUP BY image_id, class_id HAVING count(*) >= 75")
def filter_class_area(x: DataFrame) -> DataFrame:
    return s.filter_class_area(x, 75)


@add("sample_with_classes", "pixels", """SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY (image_id * 7919) % 101, image_id) AS n FROM
 (SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) FILTER (WHERE class_id IN (1, 2)) >= 100) q) z WHERE n <= 10""")
def sample_with_classes(x: DataFrame) -> DataFrame:
    return s.sample_with_classes(x, [1, 2], 10, (c("image_id") * 7919) % 101)


@add("valid_llm_items", "objects", "SELECT object_id FROM objects WHERE object_id % 11 <> 0 AND object_id % 7 <> 0")
def valid_llm_items(o: DataFrame) -> DataFrame:
    t = o.withColumns({"text": F.when(c("object_id") % 11 == 0, "  ").otherwise("the ship"), "xmin": F.when(c("object_id") % 7 != 0, c("xmin"))})
    return s.valid_llm_items(t).select("object_id")


@add("require_image", "objects files", "SELECT object_id FROM objects WHERE 'P' || patch_id || '_patch_' || pos IN (SELECT regexp_extract(name, '^([^.]*)', 1) FROM files WHERE name LIKE '%.png')")
def require_image(o: DataFrame, f: DataFrame) -> DataFrame:
    stem = f.filter(F.endswith("name", F.lit(".png"))).select(F.regexp_extract("name", r"^([^.]*)", 1).alias("stem"))
    return s.require_image(o.withColumn("stem", F.concat(F.lit("P"), "patch_id", F.lit("_patch_"), "pos")), stem, "stem").select("object_id")


@add("patches_of_image", "files", "SELECT name FROM files WHERE starts_with(name, 'P3_patch_')")
def patches_of_image(f: DataFrame) -> DataFrame:
    return s.patches_of(f, "P3").select("name")


@add("random_effect", "files", "SELECT file_id, CASE WHEN k % 100 < 30 THEN (['bw', 'grain', 'sepia'])[CAST(floor(k / 100) AS BIGINT) % 3 + 1] END AS effect FROM (SELECT file_id, (file_id * 7919 + 13) % 10007 AS k FROM files) q")
def random_effect(f: DataFrame) -> DataFrame:
    return f.select("file_id", s.random_effect(F.expr(SQL_MIX), 30, ["bw", "grain", "sepia"]).alias("effect"))


@add("first_llm_round", "exprs", "SELECT patch_id, target_id, pos FROM (SELECT patch_id, target_id, unnest(range(0, 8)) AS pos FROM (SELECT DISTINCT patch_id, target_id FROM exprs) t) q WHERE pos < 5")
def first_llm_round(e: DataFrame) -> DataFrame:
    """Twice the phrases of a target: a second round of originals, enhanced and unique ones follows the first."""
    again = e.unionByName(e.withColumn("pos", c("pos") + 4))
    return s.first_round(again.withColumn("expr_type", F.when(c("pos") == 4, "unique").otherwise(c("expr_type")))).select("patch_id", "target_id", "pos")


@add("assign_effects", "files", f"SELECT file_id, CAST(ntile(3) OVER (PARTITION BY split ORDER BY {SQL_MIX}, file_id) AS INT) AS effect FROM files")
def assign_effects(f: DataFrame) -> DataFrame:
    return s.assign_effects(f, "split", "file_id", F.expr(SQL_MIX)).select("file_id", "effect")


@add("assign_transfers", "files", f"""SELECT file_id, CASE WHEN n <= t - m THEN NULL WHEN n - (t - m) <= ceil(m / 2.0) THEN a ELSE b END AS target FROM (SELECT file_id,
 row_number() OVER (PARTITION BY domain ORDER BY {SQL_MIX}, file_id) AS n, count(*) OVER (PARTITION BY domain) AS t, floor(count(*) OVER (PARTITION BY domain) / 2.0) AS m,
 CASE domain WHEN 'iSAID' THEN 'DeepGlobe' ELSE 'iSAID' END AS a, CASE domain WHEN 'LoveDA' THEN 'DeepGlobe' ELSE 'LoveDA' END AS b FROM named) q""")
def assign_transfers(f: DataFrame) -> DataFrame:
    return s.assign_transfers(named(f), ["iSAID", "DeepGlobe", "LoveDA"], "file_id", F.expr(SQL_MIX)).select("file_id", "target")


@add("first_ascii_sentence", "documents", r"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY regexp_matches(text, '^[\x00-\x7F]*$') DESC, doc_id) AS n FROM documents) q WHERE n = 1")
def first_ascii_sentence(d: DataFrame) -> DataFrame:
    return s.first_matching(d, ["source"], p.is_ascii(c("text")), "doc_id")


@add("is_ascii", "documents", r"SELECT doc_id, regexp_matches(text, '^[\x00-\x7F]*$') AS ascii FROM documents")
def is_ascii(d: DataFrame) -> DataFrame:
    return d.select("doc_id", p.is_ascii(c("text")).alias("ascii"))


@add("refcoco_ids", "exprs", "SELECT patch_id, target_id, pos, row_number() OVER (ORDER BY patch_id, target_id, pos) AS sent_id FROM exprs")
def refcoco_ids(e: DataFrame) -> DataFrame:
    return s.assign_ids(e, "patch_id", ["target_id", "pos"], "sent_id").select("patch_id", "target_id", "pos", c("sent_id").cast("bigint"))


@add("latest_result", "events", "SELECT event_type, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events GROUP BY event_type")
def latest_result(e: DataFrame) -> DataFrame:
    return s.latest_result(e, "event_type", "ts", "event_id")


# ---- orders and limits

selecting.part("image_counts", r"SELECT regexp_extract(name, '^(.*?)_patch_', 1) AS image, count(*) AS n FROM files GROUP BY ALL")


@add("top_images", "files", "SELECT image, n FROM image_counts ORDER BY n DESC, image LIMIT 10")
def top_images(f: DataFrame) -> DataFrame:
    return s.top_by_count(f, p.parse_patch_name(c("name"))[0], 10)


@add("rank_categories", "objects", "SELECT category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INT) AS rank FROM objects GROUP BY category")
def rank_categories(o: DataFrame) -> DataFrame:
    return s.rank_by_count(o, "category")


@add("order_categories", "objects", "SELECT category, count(*) AS n, CASE category WHEN 'ship' THEN 1 WHEN 'plane' THEN 2 END AS ord FROM objects GROUP BY category")
def order_categories(o: DataFrame) -> DataFrame:
    return s.order_categories(o, ["ship", "plane"])


@add("one_per_image", "exprs", "SELECT patch_id, target_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY (target_id * 31 + pos * 17) % 101, target_id, pos) AS n FROM exprs) q WHERE n = 1")
def one_per_image(e: DataFrame) -> DataFrame:
    return s.sample_n(e, 1, "patch_id", "target_id", F.struct((c("target_id") * 31 + c("pos") * 17) % 101, "target_id", "pos")).select("patch_id", "target_id", "pos")


@add("sample_items", "exprs", "SELECT target_id, pos FROM exprs WHERE patch_id IN (SELECT patch_id FROM (SELECT DISTINCT patch_id FROM exprs) d ORDER BY (patch_id * 7919) % 1009, patch_id LIMIT 20) ORDER BY (target_id * 31 + pos) % 1013, target_id, pos LIMIT 40")
def sample_items(e: DataFrame) -> DataFrame:
    order = [(c("target_id") * 31 + c("pos")) % 1013, "target_id", "pos"]
    return s.sample_items(e, "patch_id", 20, 40, (c("patch_id") * 7919) % 1009, order).select("target_id", "pos")


@add("limit_rows", "exprs", "SELECT least(25, count(*)) AS n, least(25, count(*)) AS known FROM exprs")
def limit_rows(e: DataFrame) -> DataFrame:
    """How many rows a limit gives, and how many of them are rows of the table: which rows they are is open."""
    some = s.limit_rows(e.select("target_id", "pos"), 25)
    known = some.join(e.select("target_id", "pos").distinct().withColumn("is_known", F.lit(1)), ["target_id", "pos"], "left")
    return known.agg(F.count("*").alias("n"), F.count("is_known").alias("known"))


# ---- sets

_SETS = [("iSAID", "P"), ("LoveDA", "L"), ("DeepGlobe", "D")]


def parts_of(f: DataFrame) -> dict[str, DataFrame]:
    cols = {"iSAID": ["file_id", "name"], "LoveDA": ["file_id", "split"], "DeepGlobe": ["file_id", "name", "split"]}
    return {k: f.filter(F.startswith("name", F.lit(x))).select(*cols[k]) for k, x in _SETS}


_UNION = """SELECT file_id, CASE WHEN domain <> 'LoveDA' THEN name END AS name, CASE WHEN domain <> 'iSAID' THEN split END AS split, domain AS dataset FROM named"""


@add("combine_datasets", "files", _UNION)
def all_datasets(f: DataFrame) -> DataFrame:
    return s.combine_datasets(parts_of(f))


@add("combine_exclude", "files", f"{_UNION} WHERE domain <> 'DeepGlobe'")
def some_datasets(f: DataFrame) -> DataFrame:
    return s.combine_datasets(parts_of(f), ("DeepGlobe",))


@add("all_splits", "files", "SELECT file_id, split FROM files")
def all_splits(f: DataFrame) -> DataFrame:
    return s.combine(f.filter("split = 'train'"), f.filter("split = 'val'")).select("file_id", "split")


@add("distinct_categories", "objects", "SELECT DISTINCT category FROM objects")
def distinct_categories(o: DataFrame) -> DataFrame:
    return s.distinct_values(o, "category")


@add("missing_classes", "pixels", "SELECT class_id FROM (SELECT unnest(range(0, 12)) AS class_id) e WHERE class_id NOT IN (SELECT class_id FROM pixels)")
def missing_classes(x: DataFrame) -> DataFrame:
    return s.missing_values(x.sparkSession.range(12).select(c("id").alias("class_id")), x, "class_id")


# ---- names

@add("parse_patch_name", "files", r"SELECT file_id, regexp_extract(name, '^(.*?)_patch_', 1) AS image, TRY_CAST(regexp_extract(name, '_patch_(\d+)', 1) AS INT) AS patch_number FROM files")
def parse_patch_name(f: DataFrame) -> DataFrame:
    return f.select("file_id", *p.parse_patch_name(c("name")))


@add("transform_suffix", "files", "SELECT file_id, CASE domain WHEN 'iSAID' THEN '_toP' WHEN 'DeepGlobe' THEN '_toD' WHEN 'LoveDA' THEN '_toL' ELSE '_unk' END AS suffix FROM named")
def transform_suffix(f: DataFrame) -> DataFrame:
    return named(f).select("file_id", p.transform_suffix(c("domain")).alias("suffix"))


@add("sample_kind", "exprs", "SELECT patch_id, pos, CASE WHEN count(*) > 1 THEN 'group' ELSE 'individual' END AS kind FROM exprs WHERE pos < 2 AND target_id % 20 < 15 + 5 * pos AND (pos = 1 OR target_id % 20 = 0) GROUP BY patch_id, pos")
def sample_kind(e: DataFrame) -> DataFrame:
    ids = e.filter("pos < 2 and target_id % 20 < 15 + 5 * pos and (pos = 1 or target_id % 20 = 0)").groupBy("patch_id", "pos").agg(F.collect_list("target_id").alias("ids"))
    return ids.select("patch_id", "pos", p.sample_kind(c("ids")).alias("kind"))


@add("estimate_tokens", "documents", "SELECT doc_id, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(d: DataFrame) -> DataFrame:
    return d.select("doc_id", p.estimate_tokens(c("text")).alias("tokens"))


@add("llm_mode", "files", "SELECT file_id, CASE WHEN name LIKE 'D%' OR name LIKE 'L%' AND file_id % 2 = 0 THEN 'mask_dual' ELSE 'bbox_dual' END AS mode FROM files")
def llm_mode(f: DataFrame) -> DataFrame:
    return f.select("file_id", p.llm_mode(c("name"), F.when(c("file_id") % 2 == 0, "group").otherwise("object")).alias("mode"))


@add("landcover_phrase", "pixels", "SELECT DISTINCT class_id, CASE class_id WHEN 2 THEN 'all buildings in the image' WHEN 4 THEN 'all water in the image' ELSE 'all class' || class_id || ' in the image' END AS phrase FROM pixels")
def landcover_phrase(x: DataFrame) -> DataFrame:
    name = F.when(c("class_id") == 2, "building").when(c("class_id") == 4, "water").otherwise(F.concat(F.lit("class"), "class_id"))
    return x.select("class_id").distinct().select("class_id", p.landcover_phrase(name).alias("phrase"))


@add("parse_target_uri", "files", "SELECT file_id, regexp_extract(name, '^([^.]*)', 1) AS image, CASE WHEN file_id % 2 = 0 THEN 'object' ELSE 'group' END AS kind, file_id AS target_id FROM files")
def parse_target_uri(f: DataFrame) -> DataFrame:
    uri = F.concat(F.lit("store/x/"), F.regexp_extract("name", r"^([^.]*)", 1), F.when(c("file_id") % 2 == 0, "_object_").otherwise("_group_"), "file_id", F.lit(".png"))
    return f.select("file_id", *p.parse_target_uri(uri))
