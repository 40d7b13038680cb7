import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilspark.sources import commits
from veilspark.streaming import stream as ST

START = dt.datetime(2024, 1, 1)


def events(spark, n=400, hours=60):
    draw = random.Random(4)
    rows = [(i, START + dt.timedelta(seconds=i * hours * 3600 // n), f"fp{draw.randint(0, 90)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, ST.KEPT)


def plain(rows, delay):
    last, out = {}, []
    for i, ts, fp in sorted(rows, key=lambda r: (r[1], r[0])):
        if fp not in last or ts - last[fp] > dt.timedelta(seconds=delay):
            last[fp] = ts
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 5])
def test_expiring_dedup_and_its_state(spark, slices):
    rows, df = events(spark)
    folder, progress = ST.in_arrival_order(df, slices), []
    stream = spark.readStream.schema(ST.KEPT).option("maxFilesPerTrigger", 1).parquet(folder)
    with ST.state_store(spark):
        out = ST.run_available_now(ST.expiring_dedup(stream, 3 * 3600), "t", progress=progress)
    assert sorted(r["event_id"] for r in spark.read.schema(ST.KEPT).parquet(out).collect()) == plain(rows, 3 * 3600)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    if slices > 1:
        assert len(held) >= slices and held[-1] < max(held) <= 91  # state that has expired is gone
        assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in progress) > 0


def test_expiring_dedup_of_many_fingerprints(spark):
    """State rows, and with them calls to Python, do not grow with the fingerprints."""
    draw = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=i * 30), f"fp{draw.randint(0, 4000)}" if i % 50 else None) for i in range(6000)]
    df, progress = spark.createDataFrame(rows, ST.KEPT), []
    stream = spark.readStream.schema(ST.KEPT).option("maxFilesPerTrigger", 1).parquet(ST.in_arrival_order(df, 2))
    with ST.state_store(spark):
        out = ST.run_available_now(ST.expiring_dedup(stream, 10 * 3600), "t", progress=progress)
    assert sorted(r["event_id"] for r in spark.read.schema(ST.KEPT).parquet(out).collect()) == plain(rows, 10 * 3600)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= ST.BUCKETS < len({r[2] for r in rows[:3000]})


def test_arrivals_are_dealt_out_in_one_scan(spark):
    rows, df = events(spark)
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: calls.add(1) or x, "string").asNondeterministic()
    folder = ST.in_arrival_order(df.union(spark.createDataFrame([(-1, None, "none")], ST.KEPT)).repartition(3).withColumn("fp", counted("fp")), 5)
    assert calls.value <= len(rows) + 1
    files = spark.read.parquet(folder).groupBy(F.input_file_name()).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert len(files) == 5 and sum(f["n"] for f in files) == len(rows)
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]))


def test_window_counts_in_many_batches(spark):
    rows, df = events(spark)
    folder, progress = ST.in_arrival_order(df.withColumn("fp", F.substring("fp", 1, 3)), 6), []
    stream = spark.readStream.schema(ST.KEPT).option("maxFilesPerTrigger", 1).parquet(folder)
    got = ST.window_counts(stream, "fp", "5 hours", "1 hour", progress)
    want = df.groupBy(F.date_format(F.window("ts", "5 hours")["start"], "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.substring("fp", 1, 3).alias("fp")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) < want.count() / 2


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store, schema = str(tmp_path / "c"), "window_start string, kind string, n long, batch long"
    batches = [[("a", "x", 1, 0), ("b", "x", 4, 0)], [("a", "x", 3, 1)]]
    for i, rows in [(0, batches[0]), (1, batches[1]), (1, batches[1]), (0, batches[0])]:
        commits.commit(spark.createDataFrame(rows, schema), store, f"{i:012d}")
    got = ST.latest_counts(commits.committed(spark, store, schema), "kind").collect()
    assert sorted(map(tuple, got)) == [("a", "x", 3), ("b", "x", 4)]
