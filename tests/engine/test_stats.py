"""Statistics against plain Python."""

import statistics

from groundphrase.operators import selection as se
from groundphrase.operators import stats as st
from pyspark.sql import functions as F


def test_exact_median(spark):
    groups = {"one": [0.3], "even": [0.0, 1.0, 0.2, 0.9], "ties": [0.5] * 7 + [0.1] * 7, "many": [(i * 7919 % 1000) / 999 for i in range(500)], "near": [0.5 + i / 1e6 for i in range(100)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r.median for r in st.exact_median(df, "g", "v").collect()}
    assert got.keys() == groups.keys() and all(abs(got[g] - statistics.median(vs)) < 1e-12 for g, vs in groups.items())


def test_a_table_that_does_not_agree_is_found(spark):
    rows = [(1, "individual", 1, "original", "train"), (1, "individual", 1, "unique", "train"), (1, "group", 5, "enhanced", "val"), (2, "individual", 2, "unique", "val")]
    e = spark.createDataFrame(rows, "patch_id long, target_kind string, target_id long, expr_type string, split string")
    tables = st.published_tables(e)
    assert all(r.ok for r in st.validate_tables(tables).collect())
    wrong = tables | {"llm": tables["llm"].withColumn("n", F.col("n") + (F.col("split") == "total").cast("int"))}
    bad = {r.check_name for r in st.validate_tables(wrong).filter("not ok").collect()}
    assert bad == {f"llm/{k}/total" for k in ("original", "enhanced", "unique")}
    less = tables | {"dataset": tables["dataset"].withColumn("groups", F.when(F.col("split") == "val", 0).otherwise(F.col("groups")))}
    assert {r.check_name for r in st.validate_tables(less).filter("not ok").collect()} == {"splits/groups", "samples/val"}


def test_ranks_in_parts(spark):
    rows = [(("a", "b", None)[i % 3] if i % 5 else "a", (i * 37) % 50 - 20, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = {r.i: (r._n, r._t) for r in se.ranked(df, "g", F.col("k"), "i", parts=7).collect()}
    for g in ("a", "b", None):
        ordered = sorted((k, i) for x, k, i in rows if x == g)
        assert [got[i] for _, i in ordered] == [(n + 1, len(ordered)) for n in range(len(ordered))]
    hashed = se.assign_effects(df, "g", "i").groupBy("g", "effect").count().collect()
    assert len(hashed) == 9 and all(max(r["count"] for r in hashed if r.g == g) - min(r["count"] for r in hashed if r.g == g) <= 1 for g in ("a", "b", None))
    assert se.assign_effects(df.limit(2), "g", "i").count() == 2 and se.split_ratio(df.limit(0), 0.5, "i").count() == 0
