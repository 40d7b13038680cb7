"""Corpus operators: cleaning, first-wins dedup, quotas, exact splits."""

from pyspark.sql import functions as F

from veilspark.functions import text as TX
from veilspark.operators import corpus as CO
from veilspark.operators import splits as S


def test_clean_strip_collapse_cut(spark):
    rows = [("  a\r\nb  c\t ",), (" x  y　",), ("z" * 600,), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r["c"] for r in df.select(TX.clean(F.col("t")).alias("c")).collect()]
    assert got[:2] == ["a b c", "x y"]
    assert len(got[2]) == 500 and got[3] is None
    # idempotent where the cut does not end in a blank
    again = df.select(TX.clean(TX.clean(F.col("t"))).alias("c")).collect()
    assert [r["c"] for r in again] == got


def test_first_nonempty(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), ("", "")], "x string, y string")
    got = [r["v"] for r in df.select(TX.first_nonempty(F.col("x"), F.col("y")).alias("v")).collect()]
    assert got == ["b", "b", "a", None]


def test_first_wins_keeps_first_source_label(spark):
    rows = [(10, "same text", "PUBLIC", 2), (11, "same text", "SENSITIVE", 1), (12, "other", "PUBLIC", 3),
            (13, "same text", "PUBLIC", 1)]
    df = spark.createDataFrame(rows, "case_id long, text string, label string, source_rank int") \
        .withColumn("fp", F.md5("text"))
    out = {r["fp"]: r for r in CO.first_wins(df, ["fp"], ["source_rank", "case_id"]).collect()}
    survivor = [r for r in out.values() if r["text"] == "same text"][0]
    assert (survivor["case_id"], survivor["label"]) == (11, "SENSITIVE")
    assert len(out) == 2
    # idempotent
    again = CO.first_wins(CO.first_wins(df, ["fp"], ["source_rank", "case_id"]), ["fp"], ["source_rank", "case_id"])
    assert again.count() == 2


def test_splits_exact_disjoint_and_partition_independent(spark):
    df = spark.range(0, 927).withColumnRenamed("id", "case_id")
    a = S.split_train_dev_test(df, "case_id", 42)
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"train": 556, "dev": 185, "test": 186}
    b = S.split_train_dev_test(df.repartition(7).orderBy(F.rand(3)), "case_id", 42)
    assert sorted(a.select("case_id", "split", "rank").collect()) == sorted(b.select("case_id", "split", "rank").collect())
    ranks = sorted(r["rank"] for r in a.select("rank").collect())
    assert ranks == list(range(1, 928))
    h = S.split_holdout(df, "case_id", 42)
    assert h.where("split = 'dev'").count() == 463


def test_exact_rank_equals_global_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).withColumnRenamed("id", "case_id").withColumn("h", S.seeded_hash(F.col("case_id"), 7))
    a = S.exact_rank(df, "h", "case_id", prefix_len=2).select("case_id", "rank")
    b = df.withColumn("rank", F.row_number().over(Window.orderBy("h", "case_id"))).select("case_id", "rank")
    assert sorted(a.collect()) == sorted(b.collect())


def test_quota_first_n(spark):
    rows = [(i, "s" + str(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, src string")
    q = S.first_n_per_group(df, ["src"], [F.col("id")], 3)
    assert sorted(r["id"] for r in q.collect()) == [0, 1, 2, 3, 4, 5]


def test_balanced_sample(spark):
    rows = [(i, "SENSITIVE" if i % 4 == 0 else "PUBLIC", i) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id long, label string, rank long")
    b = S.balanced_sample(df, 200)
    assert {r["label"]: r["count"] for r in b.groupBy("label").count().collect()} == {"SENSITIVE": 10, "PUBLIC": 10}
