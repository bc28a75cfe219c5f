from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast


def hinted(df, **bounds):
    out = bounded_broadcast(df, **bounds)
    return "ResolvedHint" in out._jdf.queryExecution().analyzed().toString()


def test_rows_and_bytes_are_bounds(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("é"), 50).alias("s"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"), F.array(F.struct(F.lit("x").alias("t"))).alias("st"),
                                  F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit(None).cast("string").alias("none"))
    assert hinted(df) and not hinted(df, max_rows=999) and not hinted(df, max_bytes=100_000) and hinted(df, max_bytes=400_000)
    assert hinted(df.limit(0))


def test_plans_of_one_shape_are_told_apart(spark):
    one, many = (spark.createDataFrame([(i,) for i in range(n)], "i int") for n in (3, 3000))
    assert hinted(one, max_rows=100) and not hinted(many, max_rows=100) and hinted(one, max_rows=100)
