import corpus_pipeline as p
import pytest
from groundphrase.llm import mixing, quality
from groundphrase.sources import table
from pyspark.sql import functions as F
from test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in p.STAGES:
        done = stage(spark, docs, SF)
        if name != "bpe":
            assert done.columns == docs.columns
            docs = spark.createDataFrame(done.collect(), docs.schema)
        out[name] = done.collect()
    ids = {k: [r.doc_id for r in v] for k, v in out.items()}
    scored = quality.with_score(table(spark, SF, "documents"), quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels")))
    assert sorted(ids["quality"]) == sorted(r.doc_id for r in scored.filter("score >= 0.7").collect())
    first = {}
    for d in sorted(ids["quality"]):
        first.setdefault(" ".join(before[d].text.replace("\n", " ").split(" ")), d)
    assert sorted(ids["exact_dedup"]) == sorted(first.values())
    classes = brute({d: before[d].text for d in ids["exact_dedup"]}, 5, 80)
    assert sorted(ids["near_dedup"]) == sorted(d for d, (_, c) in classes.items() if c == d)
    assert sorted(ids["mixing"]) == sorted(ids["near_dedup"]) == sorted(ids["bpe"])
    assert all(r.decoded == before[r.doc_id].text and len(r.ids) > 0 for r in out["bpe"])
    assert sorted(r.doc_id for r in p.run(spark, SF).collect()) == sorted(ids["bpe"])


def test_order_of_the_mixture_survives_several_files(spark, monkeypatch):
    in_files = lambda spark, docs, sf_dir: mixing.mixed(docs, block=8, rows_per_file=40)
    monkeypatch.setattr(p, "STAGES", [(name, in_files if name == "mixing" else stage) for name, stage in p.STAGES])
    rows = p.run(spark, SF).collect()
    kept = table(spark, SF, "documents").filter(F.col("doc_id").isin([r.doc_id for r in rows]))
    want = [r.doc_id for r in mixing.mix(kept.select("doc_id", "source"), block=8).orderBy("mix.place").collect()]
    assert len({r.place >> 40 for r in rows}) > 3 and len({r.place for r in rows}) == len(rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.place)] == want


@pytest.mark.parametrize("stage", [s for _, s in p.STAGES])
def test_empty_and_null(spark, stage):
    docs = table(spark, SF, "documents")
    assert stage(spark, docs.limit(0), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    assert stage(spark, odd, SF).count() <= 2
