import pytest
from pyspark.sql import functions as F

from cellwise.operators import skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_as_a_plain_join(spark, how):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), "id")
    right = spark.range(0, 380).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r["k"] for r in skew.hot_keys(left, "k", 0.1).collect()] == [7]
    rows = lambda d: sorted(map(str, d.select("k", "id", "v").collect()))
    assert rows(skew.salted_join(left, right, "k", F.col("id"), how, share=0.1, salts=5)) == rows(left.join(right, "k", how))


def test_empty(spark):
    e = spark.createDataFrame([], "k int, id int")
    assert skew.salted_join(e, e.withColumnRenamed("id", "v"), "k", F.col("id")).count() == skew.hot_keys(e, "k").count() == 0


def test_numbered_as_row_number(spark):
    from pyspark.sql.window import Window

    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        (F.col("id") * 7919 % 4001).alias("o"),
        "id"
    )
    want = df.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(str, skew.numbered(df, "g", [F.col("o")], "k").collect())) == sorted(map(str, want.collect()))
    assert skew.numbered(df.limit(0), "g", [F.col("o")], "k").count() == 0
