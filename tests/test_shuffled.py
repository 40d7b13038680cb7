"""A corpus written in shuffled order, and samples of many rounds."""

import hashlib
import os
import re

import pyarrow.parquet as pq
import pytest

from veilspark.operators import splits as S
from veilspark.session import scratch_path
from veilspark.sources import shuffled as SH

SCHEMA = "case_id long, text string, part string"


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def corpus(spark, n):
    return spark.createDataFrame([(i * 3, f"text {i}" if i % 5 else None, "a") for i in range(n)], SCHEMA).repartition(5)


@pytest.mark.parametrize("n, per_file", [(0, 10), (1, 10), (700, 50), (700, 1), (300, 10_000)])
def test_files_in_name_order_give_the_shuffled_order(spark, n, per_file):
    path = scratch_path(spark, "shuffled-test")
    back = SH.write_shuffled(corpus(spark, n), path, rows_per_file=per_file)
    want = order(i * 3 for i in range(n))
    assert back.columns == ["case_id", "text", "part", "ordinal"]
    got = {r["ordinal"]: r["case_id"] for r in back.collect()}
    assert [got[k] for k in sorted(got)] == want and sorted(got) == list(range(1, n + 1))
    root = path.removeprefix("file:")
    names = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet") and "=" in d)
    assert [i for f in names for i in pq.ParquetFile(f).read(["case_id"]).column(0).to_pylist()] == want
    assert all(pq.ParquetFile(f).metadata.num_rows < per_file + 50 for f in names)
    assert len(names) >= (n // (2 * per_file + 50))
    assert [r["case_id"] for r in SH.slice_of(back, 3, 5).orderBy("ordinal").collect()] == want[2:5]


def test_rows_are_shuffled_once_and_by_file(spark):
    starts = SH.file_starts(corpus(spark, 100).selectExpr("substr(md5(string(case_id)), 1, 4) as _b"), 10, 4)
    rows = sorted((r["_b"], r["rows_before"]) for r in starts.collect())
    assert [r[1] for r in rows] == sorted(r[1] for r in rows) and len({r[1] for r in rows}) == 10


def test_samples_of_all_rounds(spark):
    df = corpus(spark, 400)
    got = S.seeded_samples(df, 30, [1, 2, 7])
    for rnd in (1, 2, 7):
        one = S.seeded_sample(df, 30, "case_id", 42, rnd)
        assert sorted(map(tuple, got.where(f"round = {rnd}").drop("round").collect(), ), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert S.seeded_samples(df.limit(0), 30, [1, 2]).count() == 0
    assert S.seeded_samples(df, 1000, [1, 2]).count() == 800
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("WindowGroupLimit", plan)) >= 2
