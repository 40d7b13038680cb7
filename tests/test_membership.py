"""Evaluation sets as bitmaps against counting rows."""

import random

from pyspark.sql import functions as F

from veilspark.operators import evaluate as E
from veilspark.operators import membership as M

PRED = "config_id int, case_id long, label string, predicted string, latency_ms double"


def predictions(n, seed=3):
    draw = random.Random(seed)
    kinds = ["SENSITIVE", "PUBLIC"]
    ids = [0, 1, 32_768, 32_769, 10**9, *range(70_000, 70_000 + n)]
    return [(c, i, draw.choice(kinds), draw.choice([*kinds, "UNKNOWN"]), draw.choice([None, 0.0, 12.5])) for c in (1, 2, 3) for i in ids]


def test_metrics_equal_counting_the_rows(spark):
    rows = predictions(400)
    pred = spark.createDataFrame(rows, PRED)
    ids = sorted({r[1] for r in rows})
    sets = {"all": ids, "odd": [i for i in ids if i % 2], "one": [32_769], "none": [5], "far": [10**9, 0]}
    members = spark.createDataFrame([(s, i) for s, of in sets.items() for i in [*of, of[0]]] + [("all", None)], "eval_set string, case_id long")
    got = M.set_metrics(M.outcome_cells(pred), M.bitmaps(members, ["eval_set"]))
    want = E.metrics(E.confusion(pred.join(members.distinct(), "case_id"), ("eval_set", "config_id")))
    cols = [c for c in got.columns if c in want.columns]
    assert set(got.columns) == set(cols)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.where("eval_set = 'none'").count() == 0


def test_a_block_is_made_where_its_rows_meet(spark):
    """One shuffle of narrow rows by block, and no bitmap sent out before it."""
    pred = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("case_id"))
    plan = M.bitmaps(pred, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(block" in plan


def test_empty(spark):
    none = spark.createDataFrame([], PRED)
    sets = M.bitmaps(spark.createDataFrame([("a", 1)], "eval_set string, case_id long"), ["eval_set"])
    assert M.set_metrics(M.outcome_cells(none), sets).count() == 0
