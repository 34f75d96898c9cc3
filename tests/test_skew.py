"""Sliced and salted forms give what the plain forms give."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import skew
from tests.conftest import rows_of


def hot_rows(spark, n=600, seed=3):
    """Most rows share one key; orders repeat so that slices are uneven."""
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(9)}", rnd.randrange(200), i,
             rnd.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, u int, v string").repartition(5)


def test_previous_row_equals_lag(spark):
    df = hot_rows(spark)
    whole = W.partitionBy("k").orderBy("t", "u")
    plain = df.select("k", "t", "u", F.lag("v").over(whole).alias("p"),
                      (F.row_number().over(whole) > 1).alias("e"))
    for width in (1, 7, 1000):
        sliced = skew.previous_row(df, ["k"], ["t", "u"], ["v"], F.floor(F.col("t") / width))
        assert rows_of(sliced, "k", "t", "u", "previous_v", "previous_exists") == rows_of(plain)


def test_position_in_group_equals_row_number(spark):
    df = hot_rows(spark)
    plain = df.select("k", "u", F.row_number().over(W.partitionBy("k").orderBy("t", "u")).alias("n"))
    for width in (1, 13, 1000):
        sliced = skew.position_in_group(df, ["k"], ["t", "u"], F.floor(F.col("t") / width), "n")
        assert rows_of(sliced, "k", "u", "n") == rows_of(plain)


def test_salted_join_equals_join(spark):
    df = hot_rows(spark)
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = df.join(other, ["k"], how)
        for keys in (["hot"], ["hot", "k3"], []):
            hot = spark.createDataFrame([(k,) for k in keys], "k string")
            salted = skew.salted_join(df, other, ["k"], how, hot, salts=4)
            assert rows_of(salted) == rows_of(plain)


def test_attach_starts_no_job_and_leaves_the_choice_to_spark(spark):
    df = hot_rows(spark)
    other = df.select("k").distinct().withColumn("w", F.lit(1))
    joined = skew.attach(df, other, "k")
    assert "strategy=broadcast" not in joined._jdf.queryExecution().toString()
    assert "strategy=broadcast" in skew.attach(df, other, "k", bounded=True)._jdf.queryExecution().toString()
    assert joined.where("w is null").count() == 0
