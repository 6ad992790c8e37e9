from groundphrase.functions import phrases as p
from pyspark.sql import functions as F


def test_domains_of_names_in_either_case_and_with_folders(spark):
    names = {"P1.png": "iSAID", "p1.png": "iSAID", "x/P1.png": "iSAID", "P/d2.xml": "DeepGlobe", "a\\b\\l3.png": "LoveDA", "q.png": "Unknown", "P/": "Unknown", "": "Unknown", None: "Unknown"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.d for r in df.select("name", p.domain_of(F.col("name")).alias("d")).collect()} == names
