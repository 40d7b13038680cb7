"""Skew: one fingerprint / one source holding a third of all rows."""

from pyspark.sql import functions as F

from veilspark.operators import corpus as CO
from veilspark.operators import splits as S


def hot_frame(spark, n=3000):
    # every third row is a copy of the same text, spread over many partitions
    df = spark.range(0, n, numPartitions=12).select(
        F.col("id").alias("case_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot copy")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        (F.col("id") % 5).cast("int").alias("source_rank"))
    return df.withColumn("fp", F.md5("text"))


def test_first_wins_hot_key_is_partial_aggregate(spark):
    df = hot_frame(spark)
    out = CO.first_wins(df, ["fp"], ["source_rank", "case_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # map-side (partial) aggregation before the exchange: the hot key collapses per task
    assert "partial_min" in plan
    rows = out.collect()
    assert len(rows) == 2000 + 1
    hot = [r for r in rows if r["text"] == "hot copy"][0]
    assert (hot["source_rank"], hot["case_id"]) == (0, 0)


def test_quota_hot_source_is_limited_before_shuffle(spark):
    df = spark.range(0, 6000, numPartitions=12).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("src"))
    q = S.first_n_per_group(df, ["src"], [F.col("id")], 5)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = sorted(r["id"] for r in q.where("src = 'hot'").collect())
    assert got == [0, 3, 6, 9, 12]
