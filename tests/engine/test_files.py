"""Written files come back as they were."""

import json

from groundphrase.operators import enrichment as en
from groundphrase.sources import readers as rd
from groundphrase.sources import sinks as si
from pyspark.sql import functions as F


def test_annotation_xml(spark, tmp_path):
    o = spark.createDataFrame([(1, 7, 0, "ship", 1, 2, 3, 4, True), (1, 8, 1, "plane", 5, 6, 7, 8, False), (2, 9, 0, "ship", 0, 0, 1, 1, False)],
                              "patch_id long, object_id long, pos int, category string, xmin int, ymin int, xmax int, ymax int, is_cutoff boolean")
    patches = spark.createDataFrame([(1, "a.png", 480, 480), (2, "b.png", 480, 480), (3, "c.png", 480, 480)], "patch_id long, filename string, width int, height int")
    si.write_annotations_xml(si.annotation_documents(patches, o).drop("patch_id"), f"{tmp_path}/x")
    back = rd.read_annotations(spark, f"{tmp_path}/x")
    assert sorted(tuple(r)[:8] for r in back["objects"].collect()) == [("a.png", 7, "ship", 1, 2, 3, 4, True), ("a.png", 8, "plane", 5, 6, 7, 8, False), ("b.png", 9, "ship", 0, 0, 1, 1, False)]
    assert back["patches"].count() == 3 and back["groups"].count() == 0


def test_first_group_list_counts(spark, tmp_path):
    text = "<annotation><filename>L1.png</filename><groups><group><id>5</id><category>water</category><instance_ids>1, 2</instance_ids></group></groups><groups><group><id>6</id></group></groups></annotation>"
    (tmp_path / "a.xml").write_text(text)
    got = rd.read_annotations(spark, str(tmp_path))["groups"].collect()
    assert [(g.group_id, g.instance_ids) for g in got] == [(5, [1, 2])]


def test_coco_refs_and_lists(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 9, "height": 8}], "annotations": [{"id": 3, "image_id": 1, "category_name": "ship", "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, anns = rd.read_coco(spark, f"{tmp_path}/c.json")
    assert images.first().file_name == "a.png" and (anns.first().xmax, anns.first().ymax) == (4.0, 6.0)
    (tmp_path / "r.json").write_text(json.dumps({"refs": [{"ref_id": 1, "ann_id": 3, "image_id": 1, "split": "val", "sentences": [{"sent": "a"}, {"sent": "b"}]}]}))
    assert [x.sentence for x in rd.read_refs(spark, f"{tmp_path}/r.json").collect()] == ["a", "b"]
    (tmp_path / "labelled_val.txt").write_text("x.png\n\ny.png\n")
    assert sorted(map(tuple, rd.read_split_lists(spark, str(tmp_path)).collect())) == [("x", "val"), ("y", "val")]
    (tmp_path / "p.txt").write_text("1 the ship\nbad\n2\n3 a b\n")
    assert sorted((x.image_id, x.phrase) for x in rd.read_phrase_list(spark, f"{tmp_path}/p.txt", "val").collect()) == [(1, "the ship"), (3, "a b")]


def test_bank_metrics_results_and_images(spark, tmp_path):
    bank = spark.createDataFrame([("P", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 7)], rd.BANK)
    rd.write_style_bank(bank, f"{tmp_path}/bank")
    assert rd.read_style_bank(spark, f"{tmp_path}/bank").collect() == bank.collect()
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "metrics.txt").write_text("a\n\nb\nc\nd\ne\nf\n")
    assert [tuple(x) for x in rd.read_run_metrics(spark, f"{tmp_path}/run*/metrics.txt").collect()] == [("run1", list("abcde"))]
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "k.json").write_text('{"n": 5}')
    assert rd.read_result_dir(spark, f"{tmp_path}/res", "n int").first().file == "k.json"
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "bad.png").write_bytes(b"no picture")
    assert rd.read_images(spark, f"{tmp_path}/img").count() == 0


def test_replies_and_requests(spark, tmp_path):
    good = '{"enhanced_expressions": [{"original_expression": "a", "variation": "b"}], "unique_expressions": ["c", " "]}'
    texts = [good, f"```json\n{good}\n```", f"x ``` {good} ``` y", f"so `{good}` it is", f"Here: {good} bye", "no {", "", None, "[1]"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, value string")
    parsed, rejects = en.split_replies(lines, "value")
    assert sorted(r.id for r in parsed.collect()) == [0, 1, 2, 3, 4] and sorted(r.id for r in rejects.collect()) == [5, 6, 7, 8]
    assert parsed.count() * 2 == en.explode_response(parsed, "id").count()
    t = spark.createDataFrame([("val", ["p", "q"])], "split string, phrases array<string>")
    si.write_lines(en.build_request(t, F.lit("store/a.png")), f"{tmp_path}/req", ["split"])
    line = json.loads(spark.read.text(f"{tmp_path}/req").first().value)
    assert line["request"]["contents"][0]["parts"][1]["fileUri"] == "store/a.png"
    si.write_report({"t": t.select("split")}, f"{tmp_path}/rep")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rep/t").first().split == "val"


def test_full_annotation(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<annotation><filename>P1.png</filename><object><id>1</id><name>ship</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox>
<is_cutoff>true</is_cutoff><color>light</color><possible_colors>light, dark</possible_colors><relationships><relationship><target_id>2</target_id><target_category>plane</target_category><direction>above</direction>
<distance>1.5</distance><possible_directions>above,below</possible_directions></relationship></relationships><expressions><expression>the ship</expression><expression id="0">a boat</expression><expression type="unique">one</expression></expressions></object>
<groups><group><id>7</id><instance_ids>1,2</instance_ids><size>2</size><category>ship</category><expressions><expression>all ships</expression></expressions></group>
<relationships><relationship><source_id>7</source_id><target_id>8</target_id><direction>below</direction><distance>2.0</distance></relationship></relationships></groups></annotation>""")
    a = rd.read_annotations(spark, str(tmp_path))
    assert [(r.target_id, r.possible_directions) for r in a["relations"].collect()] == [(2, ["above", "below"])]
    assert a["objects"].first().possible_colours == ["light", "dark"] and a["group_relations"].first().target_id == 8
    said = sorted((r.target_kind, r.pos, r.expr_type, r.text) for r in a["expressions"].collect())
    assert said == [("group", 0, "original", "all ships"), ("individual", 0, "original", "the ship"), ("individual", 1, "enhanced", "a boat"), ("individual", 2, "unique", "one")]
    samples = rd.read_samples(spark, str(tmp_path), "val")
    assert sorted((r.text, r.xmin) for r in samples.collect()) == [("a boat", 1), ("all ships", 1), ("one", 1), ("the ship", 1)]
    si.export_samples(samples, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").filter("expression_text = 'all ships' and bbox.xmin = 1 and category = 'ship' and group_size = 2 and split = 'val'").count() == 1
    published = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(published.columns) == sorted(si.SAMPLE) and len(si.SAMPLE) == 23
    assert all(published.filter(f"{c} is null").count() == 0 for c in published.columns)


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([("val", 1, "individual", 5, 1, "unique", "b"), ("val", 1, "individual", 5, 0, "original", "a"), ("train", 2, "group", 6, 0, "original", "c")],
                              "split string, patch_id long, target_kind string, target_id long, pos int, expr_type string, text string")
    si.export_refcoco(e, f"{tmp_path}/r")
    refs = spark.read.json(f"{tmp_path}/r/refs")
    assert [[s.sent for s in x.sentences] for x in refs.filter("split = 'val'").collect()] == [["a", "b"]]
    assert sorted((x.split, x.refs, x.sentences) for x in spark.read.json(f"{tmp_path}/r/summary").collect()) == [("train", 1, 1), ("val", 1, 2)]
    si.export_chat(e, f"{tmp_path}/c", "s", "text", "expr_type")
    assert all([m["role"] for m in json.loads(x.value)["messages"]] == ["system", "user", "assistant"] for x in spark.read.text(f"{tmp_path}/c").collect())
    f = spark.createDataFrame([("P1.png", "val"), ("D1.png", "val"), ("L1.png", "train")], "name string, split string")
    si.export_bundle(f, f"{tmp_path}/b", "D")
    assert sorted(x.name for x in spark.read.parquet(f"{tmp_path}/b").collect()) == ["L1.png", "P1.png"]


def test_full_documents_come_back(spark, tmp_path):
    """Objects, relations, groups, relations of groups, phrases and masks: written, read, written and read again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("""<annotation><filename>P1.png</filename><width>480</width><height>480</height>
<object><id>1</id><name>ship</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox><is_cutoff>true</is_cutoff><grid_position>in the center</grid_position><color>light</color>
<possible_colors>light,dark</possible_colors><segmentation>{"size": [480, 480], "counts": "abc"}</segmentation><relationships><relationship><target_id>2</target_id><target_category>plane</target_category>
<direction>above</direction><distance>1.5</distance><is_cutoff>false</is_cutoff><is_borderline>true</is_borderline><possible_directions>above,below</possible_directions></relationship></relationships>
<expressions><expression>the ship</expression><expression id="1">a boat</expression><expression type="unique">one</expression></expressions><dummy_expression_ids>0,2</dummy_expression_ids></object>
<object><id>2</id><name>plane</name><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>30</xmax><ymax>40</ymax></bndbox><is_cutoff>false</is_cutoff></object>
<groups><group><id>7</id><instance_ids>1,2</instance_ids><size>2</size><category>ship</category><grid_position>in the center</grid_position><centroid><x>1.5</x><y>2.5</y></centroid>
<expressions><expression>all ships</expression></expressions></group><relationships><relationship><source_id>7</source_id><target_id>8</target_id><direction>below</direction><distance>2.0</distance></relationship></relationships></groups></annotation>
""")
    (tmp_path / "in" / "b.xml").write_text("<annotation><filename>P2.png</filename><width>480</width><height>480</height></annotation>")
    first = rd.read_annotations(spark, f"{tmp_path}/in")
    assert first["objects"].filter("mask is not null").count() == 1 and first["expressions"].filter("is_dummy").count() == 2
    si.write_annotations_xml(si.full_documents(first), f"{tmp_path}/out")
    second = rd.read_annotations(spark, f"{tmp_path}/out")
    for name, table in first.items():
        assert sorted(map(repr, table.collect())) == sorted(map(repr, second[name].collect())), name
    assert {k: v.count() for k, v in second.items()} == {"patches": 2, "objects": 2, "relations": 1, "groups": 1, "group_relations": 1, "expressions": 4}
    s = rd.read_samples(spark, f"{tmp_path}/out", "val").filter("target_kind = 'group'").first()
    assert (s.xmin, s.ymin, s.xmax, s.ymax, s.category) == (1, 2, 30, 40, "ship")


def test_boxes_with_descriptions(spark, tmp_path):
    thing = "<object><bndbox><xmin>{}</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox><description>{}</description></object>"
    (tmp_path / "xml").mkdir()
    for i, split in ((1, "val"), (2, "val"), (3, "train"), (4, "val")):
        (tmp_path / "xml" / f"{i:05d}.xml").write_text(f"<annotation><split>{split}</split>{thing.format(9, 'other')}{thing.format(1, 'first')}{thing.format(1, 'second')}</annotation>")
    (tmp_path / "xml" / "notes.xml").write_text("<annotation><split>val</split></annotation>")
    anns = [{"image_id": i, "bbox": b, "segmentation": [{"size": [4, 4], "counts": f"m{n}"}, {}]} for n, (i, b) in enumerate([(1, [7, 7, 8, 8]), (1, [1, 2, 3, 4]), (2, [0, 0, 1, 1]), (3, [1, 2, 3, 4]), (9, [1, 2, 3, 4])])]
    (tmp_path / "i.json").write_text(json.dumps({"annotations": anns}))
    got = rd.read_box_descriptions(spark, f"{tmp_path}/xml", f"{tmp_path}/i.json", "val").collect()
    assert sorted((r.image_id, r.bbox, r.description) for r in got) == [(1, [1, 2, 3, 4], "first"), (2, [0, 0, 1, 1], "the object in the image")]
    assert json.loads(next(r.segmentation for r in got if r.image_id == 1))["counts"] == "m1"
