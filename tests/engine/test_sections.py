"""Sections of JSON documents, with blocks that end anywhere."""

import json
import random

import pytest
from groundphrase.sources import readers as rd
from groundphrase.sources.sections import read_section

NASTY = ['}', '{', '"', "\\", '\\"', "]", "[", '"annotations": [{', "é", "a", " ", "\n", '},{"id": 9', ":", ","]


def thing(r, i):
    text = "".join(r.choice(NASTY) for _ in range(r.randrange(12)))
    more = [{}, {"segmentation": {"size": [1, 2], "counts": text}}, {"annotations": [{"id": -1}, {}]}, {"deep": [[[{"x": text}]], {"y": {"z": []}}]}]
    return {"id": i, "t": text, **r.choice(more)}


def document(r, first):
    mine = [thing(r, first + i) for i in range(r.randrange(9))]
    sections = {"info": {"annotations": [{"id": -2}], "a": {"b": "}"}}, "note": "a}b{\"", "n": 5, "images": [thing(r, -3) for _ in range(r.randrange(4))],
                "names": ["x", "}", "annotations"], "none": [], "grid": [[1, [2]], [{"id": -4}]], "annotations": mine}
    keys = list(sections)
    r.shuffle(keys)
    return {k: sections[k] for k in keys if k == "annotations" or r.random() < 0.7}, mine


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_blocks_end_anywhere(spark, tmp_path, size):
    r, expected = random.Random(size), []
    for f in range(2):
        texts = []
        for k in range(2 if size == 7 else 12):
            doc, mine = document(r, 1000 * f + 20 * k)
            expected += mine
            texts.append(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5))
        (tmp_path / f"{f}.json").write_text("\n".join(texts) + "\n" * f)
    (tmp_path / "empty.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = read_section(spark, str(tmp_path), "annotations").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((json.loads(x.value) for x in got), key=lambda d: d["id"]) == sorted(expected, key=lambda d: d["id"])
    # numbers follow the order in a file
    for f in range(2):
        ids = [json.loads(x.value)["id"] for x in sorted((x for x in got if x.file.endswith(f"/{f}.json")), key=lambda x: x.number)]
        assert ids == sorted(ids)


def test_coco_by_blocks_is_coco(spark, tmp_path):
    doc = {"info": {}, "images": [{"id": 1, "file_name": "a}.png", "width": 9, "height": 8}], "annotations": [{"id": 3, "image_id": 1, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 1, 1]]}, {"id": 4, "image_id": 1, "bbox": None}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    for whole, split in zip(rd.read_coco(spark, f"{tmp_path}/c.json"), rd.read_coco_blocks(spark, f"{tmp_path}/c.json"), strict=True):
        assert whole.schema == split.schema and sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    (tmp_path / "none.json").write_text('{"images": []}')
    assert [d.count() for d in rd.read_coco_blocks(spark, f"{tmp_path}/none.json")] == [0, 0]
