import random
import zlib

import numpy as np

from veilspark.llm import quality

from .helpers import DOCS, docs

random.seed(2)
LABELS = "doc_id long, quality int"


def good(n=60):
    return " ".join(random.choice(["der", "house", "runs", "quickly", "over", "a", "longer", "sentence"]) for _ in range(n)) + "."


def bad(n=40):
    return random.choice([lambda: "BUY!! NOW!! " * n, lambda: "x | y | z\n" * n, lambda: "same " * n, lambda: " ".join("w%d***" % random.randrange(99) for _ in range(n))])()


def table(spark, n=1200):
    rows = [(i, good(random.randrange(30, 200)) if i % 4 else bad(random.randrange(20, 90))) for i in range(n)]
    return docs(spark, [(*r, "x") for r in rows], DOCS + ", score string"), spark.createDataFrame([(i, int(bool(i % 4))) for i in range(n) if i % 3], LABELS)


def test_held_out_accuracy_and_columns(spark):
    rows, labels = table(spark)
    got = quality.score(rows, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and np.mean([r["predicted"] == bool(r["doc_id"] % 4) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = table(spark, 300)
    flipped = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["when"]).when(quality.fold() == 0, 1 - labels.quality).otherwise(labels.quality))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(rows, x).collect()} for x in (labels, flipped))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_few_labels_nulls_and_empty(spark):
    rows = docs(spark, [(1, None), (2, ""), (None, "text"), (4, "a" * 200_000), (4, "a" * 200_000)])
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score(rows, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 7), (4, 1)], LABELS)
    assert quality.score(rows, odd).count() == 5
    assert quality.score(docs(spark, []), none).count() == 0
    assert quality.keep_good(rows, none).count() == 5


def test_pools_are_monotone():
    first, last, level = quality.pool(np.array([1, 0, 2, 1, 4.0]), np.array([2, 2, 2, 2, 4.0]))
    assert (np.diff(level) > 0).all() and first[0] == 0 and last[-1] == 4
    assert level.tolist() == [0.25, 0.75, 1.0]
