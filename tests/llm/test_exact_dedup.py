import __spark_entry__ as entry
from groundphrase.llm import exact_dedup as x
from oracle import same

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    same(entry.queries()["op6_exact_dedup"](spark, SF), entry.oracle_sql()["op6_exact_dedup"], SF)


def test_edges(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (None, "a b"), (7, "q"), (7, "q"), (8, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, digest string")
    got = {}
    for r in x.exact_groups(docs).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 3, True)] and got[3] == [(1, 3, False)] and got[None] == [(1, 3, False)]
    assert got[2] == [(2, 2, True)] and got[5] == [(2, 2, False)]
    assert sorted(got[7]) == [(7, 2, False), (7, 2, True)] and got[8] == [(8, 1, True)]
    kept = x.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 8]
    assert x.exact_groups(docs.limit(0)).count() == 0 and x.drop_exact_copies(docs.limit(0)).count() == 0


def test_frequent_texts_are_settled_by_broadcast(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) text")
    rows = docs.selectExpr("doc_id", "text digest", "0L row")
    assert [(r.digest, r.first.doc_id, r.n) for r in x.frequent_groups(rows).collect()] == [("hot", 0, 1000)]
    assert x.drop_exact_copies(docs).count() == 2001
