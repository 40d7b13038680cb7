"""Size-checked broadcasts and scan spreading, decided without running jobs."""

from pyspark.sql import functions as F

from veilspark.operators.joins import estimated_bytes, join_small, spread
from veilspark.operators.splits import first_n_per_group
from veilspark.plans import catalog
from veilspark.sources.tables import table

SF = "/root/testdata/sf0.001"


def hinted(df):
    return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_broadcast_hint_only_within_the_limit(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert 0 < estimated_bytes(labels) < 1 << 20
    assert hinted(join_small(docs, labels, "doc_id"))
    assert not hinted(join_small(docs, labels, "doc_id", limit=10))


def jobs(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def test_spread_runs_nothing_and_leaves_joins_alone(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = docs.join(labels, "doc_id").groupBy("source").count()
        assert jobs(spark, "spread", lambda: spread(joined)) == 0
        assert spread(joined) is joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Repartition" in spread(docs)._jdf.queryExecution().analyzed().toString()


def test_building_queries_only_reads_schemas(spark):
    for name in ("hybrid_cascade", "classifier_metrics", "eval_by_subset"):
        assert jobs(spark, name, lambda n=name: catalog.QUERIES[n](spark, SF)) <= 3, name


def test_quota_beyond_the_window_limit(spark):
    df = spark.range(0, 9000, numPartitions=6).withColumn("g", F.lit("hot"))
    got = first_n_per_group(df, ["g"], [F.col("id")], 5000)
    assert "_bucket" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in got.collect()) == list(range(5000))
