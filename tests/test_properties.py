from pyspark.sql import functions as F

from quire.functions import properties as PR


def test_properties_and_targets(spark):
    df = spark.createDataFrame(
        [({"Title": " old ", "Author": " ", "CreationDate": "D:20240102030405+02'00'", "ModDate": "soon"}, " New ")],
        "info map<string,string>, xmp string",
    )
    p = df.select(PR.doc_properties(F.col("info"), F.col("xmp")).alias("p")).select(
        "p.title", "p.author", F.col("p.created").cast("string").alias("created"), "p.modified"
    ).collect()[0]
    assert tuple(p) == ("New", None, "2024-01-02 01:04:05", None)
    dests = [(0, "XYZ", [1.0, 2.0], (1, 1.0, 2.0)), (1, "FitH", [5.0], (2, None, 5.0)), (1, "FitR", [1.0, 2.0, 3.0, 4.0], (2, 1.0, 4.0)), (9, "Fit", [], None)]
    df = spark.createDataFrame([(i, k, a) for i, k, a, _ in dests], "i int, k string, a array<double>")
    got = df.select(PR.outline_target(F.col("i"), F.col("k"), F.col("a"), F.lit(3)).alias("t")).collect()
    assert [None if r.t is None else tuple(r.t) for r in got] == [d[3] for d in dests]
