"""Queries of geometry, relations, groups and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.functions import geometry as g
from groundphrase.functions import phrases as p
from groundphrase.operators import phrases as ph
from groundphrase.operators import relations as r
from groundphrase.operators.lineage import cut
from groundphrase.plans.fixtures import SIZE
from groundphrase.plans.registry import Registry

rules = Registry()
c = F.col

rules.part("geo", """SELECT *, (xmin + xmax) / 2.0 AS cx, (ymin + ymax) / 2.0 AS cy, xmax - xmin AS width, ymax - ymin AS height,
 (xmax - xmin) * (ymax - ymin) AS area FROM objects""")
_GRID = """CASE WHEN {y} >= 160 AND {y} < 320 AND {x} >= 160 AND {x} < 320 THEN 'in the center' ELSE 'in the '
 || CASE WHEN {y} < 160 THEN 'top' WHEN {y} < 320 THEN 'center' ELSE 'bottom' END || ' '
 || CASE WHEN {x} < 160 THEN 'left' WHEN {x} < 320 THEN 'center' ELSE 'right' END END"""


def _grid(x: str, y: str) -> str:
    return _GRID.format(x=x, y=y)


_INSIDE = "a.xmin >= b.xmin AND a.ymin >= b.ymin AND a.xmax <= b.xmax AND a.ymax <= b.ymax"
_CENTRE = "a.cx BETWEEN b.xmin AND b.xmax AND a.cy BETWEEN b.ymin AND b.ymax"


def _swap(text: str) -> str:
    return text.replace("a.", "@.").replace("b.", "a.").replace("@.", "b.")


_CONTAINED = f"(({_INSIDE}) OR ({_swap(_INSIDE)}) OR ({_CENTRE}) OR ({_swap(_CENTRE)}))"
rules.part("sectors", """SELECT * FROM (VALUES (1, 'to the left of', -22.5, 22.5), (2, 'to the bottom left of', 22.5, 67.5),
 (3, 'below', 67.5, 112.5), (4, 'to the bottom right of', 112.5, 157.5), (5, 'to the right of', -180.0, -157.5),
 (6, 'to the top right of', -157.5, -112.5), (7, 'above', -112.5, -67.5), (8, 'to the top left of', -67.5, -22.5)) v(n, d, lo, hi)""")
rules.part("apart", f"""SELECT a.patch_id, a.object_id, b.object_id AS target_id, a.category, b.category AS target_category,
 sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS distance, b.is_cutoff AS target_cutoff,
 degrees(atan2(a.cy - b.cy, b.cx - a.cx)) AS angle
 FROM geo a JOIN geo b ON a.patch_id = b.patch_id AND a.object_id <> b.object_id
 WHERE sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy))
   <= 150 + (a.width + a.height) / 4.0 + (b.width + b.height) / 4.0 AND NOT {_CONTAINED}""")
rules.part("angles", "SELECT DISTINCT angle FROM apart")
rules.part("fits", """SELECT x.angle, s.d, abs(x.angle - s.lo) < 15 OR abs(x.angle - s.hi) < 15 AS edge
 FROM angles x JOIN sectors s ON x.angle >= s.lo AND x.angle <= s.hi
 UNION ALL SELECT x.angle, n.d, true FROM angles x JOIN sectors s ON x.angle >= s.lo AND x.angle <= s.hi
 JOIN sectors n ON n.hi = s.lo AND abs(x.angle - s.lo) < 15 OR n.lo = s.hi AND abs(x.angle - s.hi) < 15
 UNION ALL SELECT angle, 'to the bottom right of', false FROM angles WHERE angle > 157.5""")
rules.part("turned", "SELECT angle, bool_or(edge) AS is_borderline, list_sort(list_distinct(list(d))) AS p FROM fits GROUP BY angle")
rules.part("rel", """SELECT a.patch_id, a.object_id, a.target_id, a.category, a.target_category, a.distance, a.target_cutoff, t.is_borderline,
 t.p, unnest(t.p) AS direction FROM apart a JOIN turned t ON a.angle = t.angle""")
rules.part("near", """SELECT a.patch_id, a.category, a.object_id AS a, b.object_id AS b, sqrt(
 power(greatest(0, b.xmin - a.xmax, a.xmin - b.xmax), 2) + power(greatest(0, b.ymin - a.ymax, a.ymin - b.ymax), 2)) AS gap
 FROM objects a JOIN objects b ON a.patch_id = b.patch_id AND a.category = b.category AND a.object_id < b.object_id
 WHERE NOT a.is_cutoff AND NOT b.is_cutoff AND power(greatest(0, b.xmin - a.xmax, a.xmin - b.xmax), 2)
  + power(greatest(0, b.ymin - a.ymax, a.ymin - b.ymax), 2) <= 1600""")
rules.part("arcs", "SELECT a, b FROM near UNION SELECT b, a FROM near")
rules.part("reach", """/* RECURSIVE */ SELECT a AS x, a AS y FROM arcs UNION SELECT reach.x, arcs.b FROM reach JOIN arcs ON reach.y = arcs.a""")
rules.part("comp", "SELECT x AS object_id, min(y) AS component FROM reach GROUP BY x")
rules.part("members", """SELECT o.patch_id, o.category, o.object_id, o.pos, c.component FROM comp c JOIN objects o USING (object_id)
 WHERE c.component IN (SELECT component FROM comp GROUP BY component HAVING count(*) BETWEEN 2 AND 8)""")
rules.part("classes", """SELECT patch_id, category, dense_rank() OVER (PARTITION BY patch_id ORDER BY min(pos)) AS o FROM objects
 WHERE NOT is_cutoff GROUP BY patch_id, category""")
rules.part("starts", """SELECT patch_id, category, component, dense_rank() OVER (PARTITION BY patch_id, category ORDER BY min(pos)) - 1 AS label
 FROM members GROUP BY patch_id, category, component""")
rules.part("numbered", """SELECT m.patch_id, m.category, m.object_id, m.pos, CAST(k.o * 1000 + s.label AS BIGINT) AS group_id FROM members m
 JOIN starts s USING (component) JOIN classes k ON k.patch_id = m.patch_id AND k.category = m.category""")
rules.part("loose", "SELECT * FROM objects WHERE NOT is_cutoff AND object_id NOT IN (SELECT object_id FROM members)")
rules.part("singles", """SELECT * FROM loose WHERE object_id IN (SELECT object_id FROM rel WHERE target_id IN (SELECT object_id FROM members))""")
rules.part("class_rows", """SELECT patch_id, category, row_number() OVER (PARTITION BY patch_id ORDER BY min(pos)) - 1 AS n FROM objects
 GROUP BY patch_id, category HAVING count(*) > 1""")
rules.part("pair_rows", """SELECT patch_id FROM objects GROUP BY patch_id HAVING count(*) FILTER (WHERE category = 'Small_Vehicle') > 0
 AND count(*) FILTER (WHERE category = 'Large_Vehicle') > 0""")
rules.part("in_groups", """SELECT patch_id, group_id, category AS group_class, object_id FROM numbered
 UNION ALL SELECT s.patch_id, CAST(k.o * 1000 + 500000 + row_number() OVER (PARTITION BY s.patch_id ORDER BY s.pos) - 1
   + coalesce(b.n, 0) AS BIGINT), s.category, s.object_id FROM singles s JOIN classes k ON k.patch_id = s.patch_id AND k.category = s.category
   LEFT JOIN (SELECT patch_id, count(DISTINCT group_id) AS n FROM numbered GROUP BY patch_id) b ON b.patch_id = s.patch_id
 UNION ALL SELECT o.patch_id, CAST(1000000 + k.n AS BIGINT), o.category, o.object_id FROM objects o JOIN class_rows k ON k.patch_id = o.patch_id AND k.category = o.category
 UNION ALL SELECT o.patch_id, 2000000, 'vehicle_pair', o.object_id FROM objects o JOIN pair_rows p ON p.patch_id = o.patch_id
   WHERE o.category IN ('Small_Vehicle', 'Large_Vehicle')""")
rules.part("group_boxes", """SELECT m.patch_id, m.group_id, any_value(m.group_class) AS category, count(*) AS size, avg(g.cx) AS cx, avg(g.cy) AS cy,
 min(g.xmin) AS xmin, min(g.ymin) AS ymin, max(g.xmax) AS xmax, max(g.ymax) AS ymax FROM in_groups m JOIN geo g USING (object_id) GROUP BY m.patch_id, m.group_id""")
rules.part("group_rel", f"""SELECT a.patch_id, a.group_id AS source_id, b.group_id AS target_id,
 sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS distance, degrees(atan2(a.cy - b.cy, b.cx - a.cx)) AS angle
 FROM group_boxes a JOIN group_boxes b ON a.patch_id = b.patch_id AND a.group_id <> b.group_id
 WHERE a.group_id < 1000000 AND b.group_id < 1000000 AND (a.size > 1 OR b.size > 1) AND NOT ({_INSIDE}) AND NOT ({_swap(_INSIDE)})
 AND sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) <= 150""")
rules.part("group_said", """SELECT patch_id, source_id, target_id, distance, CASE WHEN angle >= 157.5 OR angle < -157.5 THEN 'to the right of'
 WHEN angle < -112.5 THEN 'to the top right of' WHEN angle < -67.5 THEN 'above' WHEN angle < -22.5 THEN 'to the top left of'
 WHEN angle < 22.5 THEN 'to the left of' WHEN angle < 67.5 THEN 'to the bottom left of' WHEN angle < 112.5 THEN 'below'
 ELSE 'to the bottom right of' END AS direction FROM group_rel""")
_OUTER = "CASE WHEN row_number() OVER w{i} = 1 AND abs(lead({v}) OVER w{i} - {v}) > 24 THEN '{name}' END"
rules.part("outermost", f"""SELECT * FROM (SELECT patch_id, object_id, coalesce({_OUTER.format(i=1, v='cx', name='rightmost')}, {_OUTER.format(i=2, v='cx', name='leftmost')},
 {_OUTER.format(i=3, v='cy', name='bottommost')}, {_OUTER.format(i=4, v='cy', name='topmost')}) AS extreme_position FROM geo
 WINDOW w1 AS (PARTITION BY patch_id, category ORDER BY cx DESC), w2 AS (PARTITION BY patch_id, category ORDER BY cx),
 w3 AS (PARTITION BY patch_id, category ORDER BY cy DESC), w4 AS (PARTITION BY patch_id, category ORDER BY cy)) q WHERE extreme_position IS NOT NULL""")
rules.part("sized", """SELECT patch_id, object_id, 'largest' AS size_attribute FROM (SELECT *, row_number() OVER w AS n, lead(area) OVER w AS nxt FROM geo
 WINDOW w AS (PARTITION BY patch_id, category ORDER BY area DESC, object_id)) q WHERE n = 1 AND area > 1.5 * nxt
 UNION ALL SELECT patch_id, object_id, 'smallest' FROM (SELECT *, row_number() OVER w AS n, lead(area) OVER w AS nxt FROM geo
 WHERE xmin >= 0 AND ymin >= 0 AND xmax <= 480 AND ymax <= 480 WINDOW w AS (PARTITION BY patch_id, category ORDER BY area, object_id)) q
 WHERE n = 1 AND 1.5 * area < nxt""")
_WORDS = "|".join(p.CLASS_NAMES.values())


def _std(x: str) -> str:
    """The standardised phrase, as DuckDB text."""
    out = f"lower({x})"
    for name, said in p.CLASS_NAMES.items():
        if "_" in name:
            out = rf"regexp_replace({out}, '\b{name.lower()}\b', '{said}', 'g')"
    out = rf"regexp_replace({out}, '\bgroup of 1 ({_WORDS})\b', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\b(group of [0-9]+ (?:{_WORDS}))\b', '\1s', 'g'), '\b(all (?:{_WORDS}))\b', '\1s', 'g')"


rules.part("attributed", f"""SELECT o.*, {_grid('o.cx', 'o.cy')} AS grid, e.extreme_position AS ex, z.size_attribute AS sz,
 CASE o.object_id % 4 WHEN 0 THEN ['light'] WHEN 1 THEN ['light', 'dark'] WHEN 2 THEN (CASE WHEN o.category = 'building' THEN [] ELSE ['green'] END) ELSE [] END AS colours,
 o.object_id % 4 = 1 AS is_ambiguous FROM geo o LEFT JOIN outermost e USING (object_id) LEFT JOIN sized z USING (object_id)""")
rules.part("told", """SELECT object_id, 'that is ' || d || ' a ' || target_category AS text, target_cutoff AS dummy
 FROM (SELECT r.object_id, r.target_category, r.target_cutoff, unnest(r.p) AS d FROM rel r) q""")
rules.part("heads", """SELECT object_id, category, grid, is_cutoff AS dummy, h.bare, h.head FROM attributed, LATERAL (SELECT unnest(list_filter([
 {'bare': true, 'head': ''}, {'bare': true, 'head': ex || ' '}], lambda z: z.head IS NOT NULL), recursive := true)) h
 UNION ALL SELECT object_id, category, grid, is_cutoff, h.bare, h.head FROM attributed, LATERAL (SELECT unnest(list_filter([
 {'bare': true, 'head': ''}, {'bare': true, 'head': ex || ' '}], lambda z: z.head IS NOT NULL), recursive := true)) h
 WHERE NOT is_ambiguous AND len(colours) > 0
 UNION ALL SELECT object_id, category, grid, is_cutoff OR is_ambiguous, h.bare, k || ' ' || h.head FROM
 (SELECT *, unnest(colours) AS k FROM attributed) a, LATERAL (SELECT unnest(list_filter([
 {'bare': true, 'head': ''}, {'bare': true, 'head': ex || ' '}], lambda z: z.head IS NOT NULL), recursive := true)) h""")
rules.part("phrases", """SELECT h.object_id, 'the ' || head || category AS text, dummy FROM heads h WHERE bare
 UNION ALL SELECT object_id, 'the ' || head || category || ' ' || grid, dummy FROM heads
 UNION ALL SELECT h.object_id, 'the ' || head || category || ' ' || grid || ' ' || t.text, h.dummy OR t.dummy FROM heads h JOIN told t USING (object_id)""")
rules.part("unique_rows", f"""SELECT patch_id, object_id, norm AS text FROM (SELECT o.patch_id, f.object_id, f.dummy, {_std('f.text')} AS norm,
 count(*) OVER (PARTITION BY o.patch_id, {_std('f.text')}) AS n FROM phrases f JOIN objects o USING (object_id)) q WHERE n = 1 AND NOT dummy""")
rules.part("group_texts", f"""SELECT b.patch_id, b.group_id, CASE WHEN b.group_id >= 2000000 THEN 'all small and large vehicles in the image'
 WHEN b.group_id >= 1000000 THEN 'all ' || b.category || ' in the image' ELSE 'the group of ' || b.size || ' ' || b.category || ' ' || {_grid('b.cx', 'b.cy')} END AS text
 FROM group_boxes b WHERE b.size > 1
 UNION ALL SELECT b.patch_id, b.group_id, CASE WHEN b.size = 1 THEN 'the ' ELSE 'the group of ' || b.size || ' ' END || b.category || ' ' || {_grid('b.cx', 'b.cy')}
 || ' that is ' || s.direction || ' a group of ' || t.size || ' ' || t.category FROM group_boxes b JOIN group_said s ON s.patch_id = b.patch_id AND s.source_id = b.group_id
 JOIN group_boxes t ON t.patch_id = s.patch_id AND t.group_id = s.target_id WHERE b.size > 1 OR t.size > 1""")


# ---- geometry

@rules.add("box_geometry", "objects", "SELECT object_id, cx, cy, width, height, area FROM geo")
def box_geometry(o: DataFrame) -> DataFrame:
    return g.with_geometry(o).select("object_id", "cx", "cy", "width", "height", "area")


@rules.add("box_convert", "objects", "SELECT object_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, xmin, ymin, xmax, ymax FROM objects")
def box_convert(o: DataFrame) -> DataFrame:
    boxes = o.select("object_id", *g.xywh(c("xmin"), c("ymin"), c("xmax"), c("ymax")))
    return boxes.select("*", *g.corners(c("x"), c("y"), c("w"), c("h")))


@rules.add("bbox_distance", "objects", "SELECT a, b, round(gap, 4) AS gap FROM near")
def bbox_distance(o: DataFrame) -> DataFrame:
    return r.near_pairs(o).select("a", "b", F.round("gap", 4).alias("gap"))


@rules.add("grid_position", "objects", f"""SELECT object_id, {_grid('cx', 'cy')} AS grid_position,
 abs(cx - 160) < 48 OR abs(cx - 320) < 48 OR abs(cy - 160) < 48 OR abs(cy - 320) < 48 AS is_borderline,
 len(vs) * len(hs) AS n_possible, list_aggregate(list_sort(flatten(list_transform(vs, lambda v: list_transform(hs, lambda h:
   CASE WHEN v = 'center' AND h = 'center' THEN 'in the center' ELSE 'in the ' || v || ' ' || h END)))), 'string_agg', ',') AS possible
 FROM (SELECT *, CASE WHEN abs(cy - 160) < 48 THEN ['top', 'center'] WHEN abs(cy - 320) < 48 THEN ['center', 'bottom']
   WHEN cy < 160 THEN ['top'] WHEN cy < 320 THEN ['center'] ELSE ['bottom'] END AS vs,
   CASE WHEN abs(cx - 160) < 48 THEN ['left', 'center'] WHEN abs(cx - 320) < 48 THEN ['center', 'right']
   WHEN cx < 160 THEN ['left'] WHEN cx < 320 THEN ['center'] ELSE ['right'] END AS hs FROM geo) q""")
def grid_position(o: DataFrame) -> DataFrame:
    border, possible = g.possible_positions(c("cx"), c("cy"), F.lit(SIZE), F.lit(SIZE))
    return g.with_geometry(o).select(
        "object_id", g.grid_position(c("cx"), c("cy"), F.lit(SIZE), F.lit(SIZE)).alias("grid_position"), border.alias("is_borderline"),
        F.size(possible).cast("bigint").alias("n_possible"), F.array_join(F.sort_array(possible), ",").alias("possible"))


@rules.add("direction_labels", "objects", """SELECT object_id, target_id, is_borderline, CAST(len(any_value(p)) AS BIGINT) AS n,
 list_aggregate(any_value(p), 'string_agg', ',') AS possible FROM rel GROUP BY object_id, target_id, is_borderline""")
def direction_labels(o: DataFrame) -> DataFrame:
    said = r.relate(o).select("object_id", "target_id", "is_borderline", F.sort_array("possible_directions").alias("p")).distinct()
    return said.select("object_id", "target_id", "is_borderline", F.size("p").cast("bigint").alias("n"), F.array_join("p", ",").alias("possible"))


@rules.add("crop_window", "objects", """SELECT object_id, greatest(0, l) AS crop_left, greatest(0, t) AS crop_top, least(480, r) AS crop_right, least(480, b) AS crop_bottom,
 greatest(0, -l) AS pad_left, greatest(0, -t) AS pad_top, greatest(0, r - 480) AS pad_right, greatest(0, b - 480) AS pad_bottom FROM
 (SELECT object_id, CAST(trunc(cx - 120) AS INT) AS l, CAST(trunc(cy - 120) AS INT) AS t, CAST(trunc(cx + 120) AS INT) AS r, CAST(trunc(cy + 120) AS INT) AS b FROM geo) q""")
def crop_window(o: DataFrame) -> DataFrame:
    return g.with_geometry(o).select("object_id", *g.crop_window(c("cx"), c("cy"), F.lit(SIZE), F.lit(SIZE)))


@rules.add("tile_xy", "customer", """SELECT c_custkey, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x,
 CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 1024) AS BIGINT) AS y
 FROM (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0 - 80 AS lat, (c_custkey * 91 % 3590) / 10.0 - 179 AS lon FROM customer) q""")
def tile_xy(t: DataFrame) -> DataFrame:
    at = t.selectExpr("c_custkey", "(c_custkey * 37 % 1600) / 10.0D - 80 AS lat", "(c_custkey * 91 % 3590) / 10.0D - 179 AS lon")
    x, y = g.tile_xy(c("lat"), c("lon"), 10)
    return at.select("c_custkey", x.alias("x"), y.alias("y"))


# ---- relations

@rules.add("containment_pairs", "objects", f"SELECT a.patch_id, a.object_id, b.object_id AS target_id FROM geo a JOIN geo b ON a.patch_id = b.patch_id AND a.object_id <> b.object_id WHERE {_CONTAINED}")
def containment_pairs(o: DataFrame) -> DataFrame:
    return r.containment_pairs(o)


@rules.add("object_relations", "objects", "SELECT patch_id, object_id, target_id, category, target_category, direction, round(distance, 4) AS distance, target_cutoff, is_borderline FROM rel")
def object_relations(o: DataFrame) -> DataFrame:
    return r.relate(o).drop("possible_directions").withColumn("distance", F.round("distance", 4))


@rules.add("rank_relations", "objects", """SELECT object_id, target_id, direction, CAST(row_number() OVER (PARTITION BY patch_id, object_id
 ORDER BY distance, target_id, direction) AS INT) AS rank FROM rel""")
def rank_relations(o: DataFrame) -> DataFrame:
    return r.rank_relations(r.relate(o)).select("object_id", "target_id", "direction", "rank")


@rules.add("near_pairs", "objects", "SELECT patch_id, category, a, b FROM near")
def near_pairs(o: DataFrame) -> DataFrame:
    return r.near_pairs(o).drop("gap")


@rules.add("extreme_positions", "objects", "SELECT * FROM outermost")
def extreme_positions(o: DataFrame) -> DataFrame:
    return r.extremes(o, SIZE, SIZE)


@rules.add("size_attribute", "objects", "SELECT * FROM sized")
def size_attribute(o: DataFrame) -> DataFrame:
    return r.size_attribute(o, SIZE, SIZE)


@rules.add("dedup_directions", "objects", """SELECT object_id, list_aggregate(list_sort(list_distinct(list(direction))), 'string_agg', ',') AS directions FROM rel GROUP BY object_id""")
def dedup_directions(o: DataFrame) -> DataFrame:
    said = r.relate(o).groupBy("object_id").agg(F.collect_list("direction").alias("d"))
    return said.select("object_id", F.array_join(F.sort_array(F.array_distinct("d")), ",").alias("directions"))


# ---- groups

def group_rows(o: DataFrame) -> DataFrame:
    return r.group_rows(o, r.clusters(o))


def described_groups(o: DataFrame) -> DataFrame:
    rows = group_rows(o)
    boxes = r.group_geometry(rows).withColumn("grid_position", g.grid_position(c("cx"), c("cy"), F.lit(SIZE), F.lit(SIZE)))
    return cut(boxes)


@rules.add("cluster_members", "objects", "SELECT patch_id, category, object_id, component FROM members")
def cluster_members(o: DataFrame) -> DataFrame:
    return r.clusters(o)


@rules.add("cluster_ids", "objects", "SELECT patch_id, category, object_id, group_id FROM numbered")
def cluster_ids(o: DataFrame) -> DataFrame:
    return r.number_clusters(o, r.clusters(o))


@rules.add("unassigned_objects", "objects", "SELECT object_id FROM loose")
def unassigned_objects(o: DataFrame) -> DataFrame:
    return r.unassigned(o, r.clusters(o)).select("object_id")


@rules.add("singles_near_clusters", "objects", "SELECT object_id, category FROM singles")
def singles_near_clusters(o: DataFrame) -> DataFrame:
    return r.singles_near_clusters(o, r.clusters(o)).select("object_id", "category")


@rules.add("class_groups", "objects", """SELECT m.patch_id, m.group_id, m.group_class AS category, string_agg(CAST(m.object_id AS VARCHAR), ',' ORDER BY o.pos) AS ids
 FROM in_groups m JOIN objects o USING (object_id) WHERE m.group_id >= 1000000 AND m.group_id < 2000000 GROUP BY m.patch_id, m.group_id, m.group_class""")
def class_groups(o: DataFrame) -> DataFrame:
    return r.class_groups(o).select("patch_id", "group_id", "category", F.array_join(c("instance_ids").cast("array<string>"), ",").alias("ids"))


@rules.add("pair_groups", "objects", """SELECT m.patch_id, m.group_id, m.group_class AS category, string_agg(CAST(m.object_id AS VARCHAR), ',' ORDER BY o.pos) AS ids
 FROM in_groups m JOIN objects o USING (object_id) WHERE m.group_id >= 2000000 GROUP BY m.patch_id, m.group_id, m.group_class""")
def pair_groups(o: DataFrame) -> DataFrame:
    return r.pair_groups(o).select("patch_id", "group_id", "category", F.array_join(c("instance_ids").cast("array<string>"), ",").alias("ids"))


@rules.add("all_groups", "objects", "SELECT patch_id, group_id, group_class AS category, count(*) AS size FROM in_groups GROUP BY patch_id, group_id, group_class")
def all_groups(o: DataFrame) -> DataFrame:
    return r.groups_of(group_rows(o)).select("patch_id", "group_id", "category", F.size("instance_ids").cast("bigint").alias("size"))


@rules.add("group_members", "objects", "SELECT patch_id, group_id, object_id FROM in_groups")
def group_members(o: DataFrame) -> DataFrame:
    return r.group_members(r.groups_of(group_rows(o)), o.drop("category")).select("patch_id", "group_id", "object_id")


@rules.add("group_geometry", "objects", "SELECT patch_id, group_id, size, round(cx, 4) AS cx, round(cy, 4) AS cy, xmin, ymin, xmax, ymax FROM group_boxes")
def group_geometry(o: DataFrame) -> DataFrame:
    boxes = r.group_geometry(group_rows(o)).drop("category")
    return boxes.withColumns({"cx": F.round("cx", 4), "cy": F.round("cy", 4)})


@rules.add("group_category", "objects", "SELECT DISTINCT patch_id, group_id, group_class AS category FROM in_groups")
def group_category(o: DataFrame) -> DataFrame:
    return r.group_category(group_rows(o))


@rules.add("group_grid_position", "objects", f"SELECT patch_id, group_id, {_grid('cx', 'cy')} AS grid_position FROM group_boxes")
def group_grid_position(o: DataFrame) -> DataFrame:
    return described_groups(o).select("patch_id", "group_id", "grid_position")


@rules.add("group_relations", "objects", "SELECT patch_id, source_id, target_id, direction, round(distance, 4) AS distance FROM group_said")
def group_relations(o: DataFrame) -> DataFrame:
    return r.relate_groups(described_groups(o)).withColumn("distance", F.round("distance", 4))


# ---- phrases

def attributed(o: DataFrame) -> DataFrame:
    """Objects with all attributes, dealt by patch; colours are made up from ids, since the tables have no pictures of them."""
    colours = F.expr("CASE object_id % 4 WHEN 0 THEN array('light') WHEN 1 THEN array('light', 'dark') WHEN 2 THEN array('green') ELSE array() END")
    extreme = r.with_extremes(g.with_geometry(o.repartition("patch_id")), SIZE, SIZE)
    return extreme.withColumns({
        "grid_position": g.grid_position(c("cx"), c("cy"), F.lit(SIZE), F.lit(SIZE)), "colours": colours, "is_ambiguous": c("object_id") % 4 == 1,
    })


@rules.add("suppress_colours", "objects", "SELECT object_id, CAST(len(colours) AS BIGINT) AS n FROM attributed")
def suppress_colours(o: DataFrame) -> DataFrame:
    return attributed(o).select("object_id", F.size(p.suppress_colours(c("category"), c("colours"))).cast("bigint").alias("n"))


@rules.add("object_phrases", "objects", "SELECT object_id, text, dummy, count(*) AS n FROM phrases GROUP BY object_id, text, dummy")
def object_phrases(o: DataFrame) -> DataFrame:
    return ph.patch_phrases(attributed(o)).select("object_id", "text", "dummy", "n")


@rules.add("unique_phrases", "objects", "SELECT patch_id, object_id, text FROM unique_rows")
def unique_phrases(o: DataFrame) -> DataFrame:
    return ph.unique_object_phrases(attributed(o))


def texts_of_groups(o: DataFrame) -> DataFrame:
    groups = described_groups(o)
    return ph.group_phrases(groups, r.relate_groups(groups))


@rules.add("group_phrases", "objects", "SELECT patch_id, group_id, text, count(*) AS n FROM group_texts GROUP BY patch_id, group_id, text")
def group_phrases(o: DataFrame) -> DataFrame:
    return texts_of_groups(o).groupBy("patch_id", "group_id", "text").agg(F.count("*").alias("n"))


@rules.add("group_phrases_text", "objects", f"SELECT {_std('text')} AS text, count(*) AS n FROM group_texts GROUP BY ALL")
def group_phrases_text(o: DataFrame) -> DataFrame:
    return texts_of_groups(o).groupBy(p.standardize_phrase(c("text")).alias("text")).agg(F.count("*").alias("n"))


@rules.add("unique_group_phrases", "objects", f"""SELECT patch_id, group_id, norm AS text FROM (SELECT patch_id, group_id, {_std('text')} AS norm,
 count(*) OVER (PARTITION BY patch_id, {_std('text')}) AS n FROM group_texts) q WHERE n = 1""")
def unique_group_phrases(o: DataFrame) -> DataFrame:
    return ph.unique_phrases(texts_of_groups(o).withColumn("dummy", F.lit(False)), "group_id").drop("pos")


@rules.add("standardize_phrase", "exprs", f"SELECT target_id, pos, {_std('text')} AS text FROM exprs")
def standardize_phrase(e: DataFrame) -> DataFrame:
    return e.select("target_id", "pos", p.standardize_phrase(c("text")).alias("text"))


@rules.add("standardize_class", "objects", r"SELECT object_id, lower(replace(category, '_', ' ')) AS name, lower(replace(category, '_', ' ')) || 's' AS names FROM objects")
def standardize_class(o: DataFrame) -> DataFrame:
    return o.select("object_id", p.standardize_class(c("category")).alias("name"), p.standardize_class(c("category"), plural=True).alias("names"))


@rules.add("pluralize", "part", r"""SELECT p_partkey, w, CASE WHEN w LIKE '%y' THEN left(w, length(w) - 1) || 'ies' WHEN w LIKE '%s' OR w LIKE '%sh' OR w LIKE '%ch'
 THEN w || 'es' ELSE w || 's' END AS many FROM (SELECT p_partkey, p_name || (['y', 's', 'ch', 'sh', 'e'])[1 + p_partkey % 5] AS w FROM part) q""")
def pluralize(t: DataFrame) -> DataFrame:
    words = t.selectExpr("p_partkey", "p_name || array('y', 's', 'ch', 'sh', 'e')[cast(p_partkey % 5 AS INT)] AS w")
    return words.select("p_partkey", "w", p.pluralize(c("w")).alias("many"))


_FLAGS = ", ".join(f"regexp_matches(lower(text), '{'|'.join(w)}') AS {k}" for k, w in p.FEATURE_WORDS.items())
rules.part("flags", f"SELECT *, {_FLAGS} FROM exprs")
_COMBO = "concat_ws('_', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in p.FEATURE_WORDS) + ")"


@rules.add("phrase_features", "exprs", f"SELECT target_id, pos, {', '.join(p.FEATURE_WORDS)} FROM flags")
def phrase_features(e: DataFrame) -> DataFrame:
    return e.select("target_id", "pos", *[f.alias(k) for k, f in p.phrase_features(c("text")).items()])


rules.part("combos", f"SELECT target_kind, {_COMBO} AS combo FROM flags WHERE expr_type = 'original'")


@rules.add("phrase_taxonomy", "exprs", """SELECT combo, count(*) FILTER (WHERE target_kind = 'individual') AS individual,
 count(*) FILTER (WHERE target_kind = 'group') AS "group", count(*) AS total FROM combos WHERE combo <> '' GROUP BY combo""")
def phrase_taxonomy(e: DataFrame) -> DataFrame:
    """Phrases are counted before their features are told, since the same ones recur in many patches. The text comes out of
    the count, so that no test of its features is pushed below it."""
    kinds = {k: c("target_kind") == k for k in ("individual", "group")}
    texts = e.filter("expr_type = 'original'").groupBy("text").agg(F.min("text").alias("said"), *[F.count_if(x).alias(k) for k, x in kinds.items()])
    combos = texts.groupBy(p.feature_combo(c("said")).alias("combo")).agg(*[F.sum(k).alias(k) for k in kinds]).filter("combo <> ''")
    return combos.withColumn("total", c("individual") + c("group"))


@rules.add("rank_taxonomy", "exprs", """SELECT combo, count(*) AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, combo) AS INT) AS rank
 FROM combos WHERE combo <> '' GROUP BY combo""")
def rank_taxonomy(e: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    counts = phrase_taxonomy(e).select("combo", "total")  # one row per combination: a bounded table
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "combo")))


@rules.add("phrase_variants", "objects", r"""SELECT object_id, position, list_aggregate(list_transform(['below', 'above'], lambda d:
 regexp_replace(position || ', that is x a', 'that is [^,]+ a', 'that is ' || d || ' a')), 'string_agg', '|') AS relation FROM
 (SELECT object_id, 'the ship in the bottom center, there' AS position FROM objects) q""")
def phrase_variants(o: DataFrame) -> DataFrame:
    at = p.position_variants(F.lit("the ship in the top left, there"), F.array(F.lit("bottom center")))[0]
    told = p.relation_variants(F.concat(c("position"), F.lit(", that is x a")), F.array(F.lit("below"), F.lit("above")))
    return o.select("object_id", at.alias("position")).withColumn("relation", F.array_join(told, "|"))


@rules.add("drop_colour_phrases", "exprs", r"SELECT target_id, pos FROM exprs WHERE NOT regexp_matches(' ' || lower(text) || ' ', ' (light|dark|red|orange|yellow|green|cyan|blue|purple|magenta) ')")
def drop_colour_phrases(e: DataFrame) -> DataFrame:
    return e.filter(p.drop_colour_words(c("text"))).select("target_id", "pos")


@rules.add("flagship", "objects", f"""SELECT combo, count(*) AS n_unique FROM (SELECT {_COMBO} AS combo FROM (SELECT u.*, {_FLAGS} FROM unique_rows u) f) q GROUP BY combo""")
def flagship(o: DataFrame) -> DataFrame:
    """Which phrase shapes identify exactly one object, and how many phrases do."""
    return ph.unique_object_phrases(attributed(o)).groupBy(p.feature_combo(c("text")).alias("combo")).agg(F.count("*").alias("n_unique"))
