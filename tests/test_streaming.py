from pyspark.sql import functions as F

from lodestar.streaming import logs


def test_append_once_skips_what_is_done(spark, tmp_path):
    source, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").write.parquet(source)
    schema = spark.read.parquet(source).schema
    run = lambda: logs.append_once(logs.read_log(spark, source, schema), target, ck, "k", lambda d: d.withColumn("n", F.length("v"))).awaitTermination()
    run()
    spark.createDataFrame([(2, "c"), (3, "dd")], "k int, v string").write.mode("append").parquet(source)
    run()
    assert sorted((r["k"], r["v"], r["n"]) for r in spark.read.parquet(target).collect()) == [(1, "a", 1), (2, "b", 1), (3, "dd", 2)]


def test_latest(spark):
    d = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, seq int, v string")
    assert sorted((r["k"], r["v"]) for r in logs.latest(d, "k", ["seq"]).collect()) == [(1, "y"), (2, "z")]
