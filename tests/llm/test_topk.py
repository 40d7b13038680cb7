import math

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    usable = sorted({(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
                     if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for q, a in usable:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c != q)
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


def run(spark, rows, every=5, k=5, **kw):
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    return {tuple(r) for r in topk.search(table, F.col("vec_id") % every == 0, k, **kw).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    assert run(spark, rows, 20, block=90, query_block=7) == brute(rows, 20, 5)


def test_ties_nulls_ragged_and_few(spark):
    rows = [(i, [1.0, 0.0, -0.5]) for i in range(12)] + [
        (20, None), (25, [1.0, None]), (30, [float("nan"), 1.0]), (35, [float("inf")]), (None, [1.0]),
        (40, []), (45, [0.0, 0.0]), (46, [2.0]), (46, [2.0]), (50, [-1.0, -1.0, -1.0, 3.0])]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert run(spark, rows[:3]) == brute(rows[:3], 5, 5)
    assert run(spark, []) == set() and run(spark, rows[:1]) == set()


def test_reading_stops_early():
    rows = np.zeros((5000, 2), np.int64)
    rows[:, 0] = np.arange(5000)
    lists = topk.Lists(np.arange(5000), rows)
    met = []
    lists.rows = type("Seen", (), {"__getitem__": lambda self, i: met.append(len(i)) or rows[i]})()
    assert [i for _, i in lists.best(-1, np.array([3, 0]), 5)] == [4999, 4998, 4997, 4996, 4995]
    assert sum(met) <= 2 * topk.DEPTH
