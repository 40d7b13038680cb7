"""Plan checks (no Python outside the scorer hook, no cross joins, limits
pushed below shuffles, rules once) and the driver contract."""

from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_cascade_plan_is_jvm_only_and_has_no_cross_join(spark):
    from veilspark.plans import catalog
    p = plan(catalog.QUERIES["hybrid_cascade"](spark, SF))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, bad
    assert "Generate" in p        # configs expanded by explode, not joined


def test_rules_appear_once(spark):
    from veilspark.plans import catalog
    p = plan(catalog.QUERIES["classify_rules_v4"](spark, SF))
    # 7 v4 rules, 1 guard and the digit test before the numeric rules, each planned once
    assert p.count("RLIKE") == 9, p.count("RLIKE")


def test_quota_uses_window_group_limit(spark):
    from veilspark.plans import catalog
    assert "WindowGroupLimit" in plan(catalog.QUERIES["source_quota"](spark, SF))


def test_split_has_no_single_partition_sort_of_data(spark):
    from veilspark.plans import catalog
    p = plan(catalog.QUERIES["split_train_dev_test"](spark, SF))
    # the only global window is over the bucket-count table (<= 65536 rows)
    assert p.count("SinglePartition") <= 1


def test_stream_equals_batch(spark):
    from veilspark.operators.classify import classify
    from veilspark.sources.tables import table
    from veilspark.streaming import stream as ST
    from pyspark.sql import functions as F
    s = ST.stream_classify(spark, SF).select("doc_id", "verdict", "matches")
    b = classify(table(spark, SF, "documents", ["doc_id", "text"]), "v4").select(
        "doc_id", "verdict", F.array_join("matches", ",").alias("matches"))
    assert sorted(s.collect()) == sorted(b.collect())
