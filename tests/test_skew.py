import pytest
from pyspark.sql import functions as F

from civicpulse.operators import skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None)
        .otherwise((F.col("id") % 50).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("2", 4), (None, 5)], "k string, v int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, "k", share=0.3)
    assert hot.count() == 1
    salted = skew.salted_join(left, right, "k", hot, how, salts=5)
    plain = left.join(right, "k", how)
    key = lambda r: (r["id"], r["k"] or "", r["v"] or 0)
    assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))


def test_hot_and_null_rows_are_spread(spark):
    left = spark.range(6400).select("id", F.when(F.col("id") % 2 == 0, "hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    hot = skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.salted_join(left, right, "k", hot, "left").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6400 and max(sizes) < 2000


def test_broadcast_hint_needs_a_small_table(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(skew.broadcast_if_small(spark.range(10), 10))
    assert not hinted(skew.broadcast_if_small(spark.range(11), 10))


def test_other_join_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        skew.salted_join(spark.range(1), spark.range(1), "id", spark.range(1), "right")


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(100_000).selectExpr("if(id % 2 = 0, 'hot', NULL) AS k", "1 AS v")
    right = spark.createDataFrame([("hot", 2)], "k string, w int")
    hot = skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    joined = skew.salted_join(left, right, "k", hot, "left")
    assert joined.where("w = 2").count() == 50_000 and joined.count() == 100_000
