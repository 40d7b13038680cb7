"""Metric goldens: counts rebuilt from the published rates must give the
published percentages; leaderboards and the constrained choice on them."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import evaluate as E

# (config_id, name, n_S, n_P, FN, FP, accuracy, FNR, FPR) -- None = not published
GOLDENS = [
    (1, "v1 Llama", 98, 93, 5, 3, 95.8, 5.1, 3.2),
    (2, "v2 Gemma C", 233, 248, 22, 30, 89.2, 9.4, 12.1),
    (3, "v3 Gemma D", 233, 248, 3, 56, 87.7, 1.3, 22.6),
    (4, "v3 Llama D", 233, 248, 11, 41, None, 4.7, 16.5),
    (5, "v4 Llama G", 233, 248, 10, 10, 95.8, 4.3, 4.0),
    (6, "v5 Llama G", 108, 133, 5, 3, 96.7, 4.6, 2.3),
    (7, "v5 Llama G stripped", 108, 133, 5, 10, 93.8, 4.6, None),
]


def predictions(spark):
    rows = []
    for cid, _, ns, np_, fn, fp, *_ in GOLDENS:
        rows += [(cid, "SENSITIVE", "PUBLIC" if i < fn else "SENSITIVE") for i in range(ns)]
        rows += [(cid, "PUBLIC", "SENSITIVE" if i < fp else "PUBLIC") for i in range(np_)]
    return spark.createDataFrame(rows, "config_id int, label string, predicted string") \
        .withColumn("latency_ms", F.lit(0.0))


@pytest.fixture(scope="module")
def metrics(spark):
    return E.metrics(E.confusion(predictions(spark))).cache()


def test_published_percentages(metrics):
    got = {r["config_id"]: r for r in metrics.collect()}
    for cid, name, *_, acc, fnr, fpr in GOLDENS:
        r = got[cid]
        if acc is not None:
            assert r["accuracy_pct"] == acc, name
        assert r["fnr_pct"] == fnr, name
        if fpr is not None:
            assert r["fpr_pct"] == fpr, name


def test_leaderboards(metrics):
    lb = E.leaderboard(metrics, "combined").orderBy("rank").collect()
    assert lb[0]["config_id"] == 6                      # v5 Llama G
    assert not any(r["target"] for r in lb)             # TARGET holds for none
    best = E.best_config(metrics, 20.0).collect()
    assert best and best[0]["config_id"] != 3           # v3 Gemma D excluded (FPR 22.6)
    assert E.best_config(metrics.where("config_id = 3"), 20.0).count() == 0   # nothing qualifies


def test_empty_class_rates_are_zero(spark):
    p = spark.createDataFrame([(1, "PUBLIC", "PUBLIC")], "config_id int, label string, predicted string")
    r = E.metrics(E.confusion(p)).first()
    assert (r["fnr"], r["fnr_pct"], r["accuracy_pct"]) == (0.0, 0.0, 100.0)


def test_three_confusion_definitions(spark):
    rows = [(1, "SENSITIVE", "PUBLIC"), (1, "SENSITIVE", "UNCERTAIN"), (1, "PUBLIC", "SENSITIVE"),
            (1, "PUBLIC", "UNCERTAIN"), (1, "PUBLIC", "PUBLIC")]
    p = spark.createDataFrame(rows, "config_id int, label string, predicted string")
    f = {d: E.confusion(p, definition=d).first() for d in ("v0", "v1", "fewshot")}
    assert (f["v0"]["false_negatives"], f["v0"]["false_positives"]) == (1, 1)
    assert (f["v1"]["false_negatives"], f["v1"]["false_positives"]) == (1, 3)
    assert (f["fewshot"]["false_negatives"], f["fewshot"]["false_positives"]) == (2, 2)


def test_leaderboard_ties_by_config_id(spark):
    p = spark.createDataFrame([(2, "PUBLIC", "PUBLIC"), (1, "PUBLIC", "PUBLIC")],
                              "config_id int, label string, predicted string")
    lb = E.leaderboard(E.metrics(E.confusion(p)), "accuracy").orderBy("rank").collect()
    assert [r["config_id"] for r in lb] == [1, 2]
