from groundphrase.operators import relations as r
from groundphrase.plans.fixtures import load
from groundphrase.streaming import apply_to_arrivals

SF = "/root/testdata/sf0.001"


def test_arrivals_equal_the_whole_table(spark, tmp_path):
    o = load(spark, SF, "objects")
    o.filter("patch_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    rule = lambda df: r.extremes(df, 480, 480)
    run = lambda: apply_to_arrivals(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in"), rule, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    run()
    o.filter("patch_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(x.batch for x in got.select("batch").distinct().collect()) == [0, 1]
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, rule(o).collect()))
