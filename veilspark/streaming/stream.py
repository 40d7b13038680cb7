"""Structured Streaming forms of the router (L1-L4).

Streams read landed parquet with ``readStream`` (schema from the batch
reader), apply the same Column expressions as the batch operators, and write
to file sinks under the shared checkpoint folder (``spark.checkpoint.dir``),
with their checkpoints there too -- restartable after executor or driver
loss. ``run_available_now`` drains what is there and stops (used by the
checks); a service would use a processing-time trigger instead.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions import prompts as P
from veilspark.operators import cascade as K
from veilspark.operators.classify import classify
from veilspark.session import scratch_path
from veilspark.sources import commits


ROUTED = "case_id long, predicted string, method string, route string"


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A stream over a table: of its folder of part files, or, where the table
    is a single file, of that file in its parent folder."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    batch = spark.read.parquet(path)
    r = spark.readStream.schema(batch.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/"))
    return r.parquet(path)


def run_available_now(df: DataFrame, name: str, output_mode: str = "append",
                      partition_by: list[str] | None = None,
                      batch_fn: Callable[[DataFrame, int], None] | None = None,
                      progress: list | None = None) -> str:
    """Drain the stream into a parquet folder (or through ``batch_fn``) and
    return the output path; ``progress`` gets a report of each micro-batch."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if batch_fn is not None:
        w = w.foreachBatch(lambda b, i: batch_fn(b, i, out))
    else:
        w = w.format("parquet").option("path", out)
        if partition_by:
            w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if progress is not None:
        progress.extend(q.recentProgress)
    return out


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on disk and in native
    memory, so it may outgrow the executors' heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_classify(spark: SparkSession, sf_dir: str, rule_set: str = "v4") -> DataFrame:
    """L1: rules on arriving messages; result equals the batch classifier."""
    s = read_stream(spark, sf_dir, "documents").select("doc_id", "text")
    c = classify(s, rule_set).select("doc_id", "verdict", F.array_join("matches", ",").alias("matches"))
    return spark.read.parquet(run_available_now(c, "stream-classify"))


def stream_route(spark: SparkSession, sf_dir: str, config: dict, rule_set: str = "v4") -> DataFrame:
    """L2: per micro-batch, the hybrid cascade (rules, scorer for undecided
    rows, fail-safe) and a write partitioned by route (local / cloud)."""
    s = read_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text",
                                                       F.lit(None).cast("string").alias("label"))

    def per_batch(b: DataFrame, batch_id: int, out: str) -> None:
        pred = K.route(K.cascade(b, [config], rule_set))
        write_batch(pred.select("case_id", "predicted", "method", "route"), batch_id, out)

    out = run_available_now(s, "stream-route", batch_fn=per_batch)
    return spark.read.schema(ROUTED).parquet(out)


def write_batch(routed: DataFrame, batch_id: int, out: str) -> None:
    """One folder a micro-batch, partitioned by route: a batch that is replayed
    after a failure replaces its own folder and adds no rows."""
    routed.write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch_id={batch_id}")


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """events.ts is TIMESTAMP_NTZ, which watermarks reject: read it as
    TIMESTAMP in the session time zone (UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def event_fingerprint() -> F.Column:
    return F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type"), F.col("props")))


def stream_dedup(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """L3: fingerprint dedup with bounded state (dropDuplicatesWithinWatermark).
    The survivor is the first arrival; a repeat later than the delay would
    appear again, so checks compare the set of fingerprints."""
    s = event_time(read_stream(spark, sf_dir, "events")).withColumn("fp", event_fingerprint())
    d = s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fp"]).select("event_id", "ts", "fp")
    return spark.read.parquet(run_available_now(d, "stream-dedup"))


KEPT = "event_id long, ts timestamp, fp string"


BUCKETS = 1024
HELD = "fps array<string>, lasts array<long>"


def expiring_dedup(events: DataFrame, delay_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """L3 with an exact rule: an event is dropped if one kept before it, with the
    same ``fp``, is at most ``delay_seconds`` older. State is one time for each
    fingerprint and goes when the watermark, the largest time seen less the
    delay, has passed the last kept event by the delay, so it is bounded by the
    events of two delays. Events that arrive in order of time are judged alike
    however they are cut into micro-batches.

    Fingerprints are judged ``buckets`` at a time, by hash: a call to Python costs
    more than the rows of most fingerprints do. The number belongs to the stream's
    checkpoint."""
    delay = delay_seconds * 1_000_000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
            keep = []
            for at, fp, us in zip(rows.index, rows["fp"], rows["ts"].astype("datetime64[us]").astype("int64")):
                if fp not in last or us - last[fp] > delay:
                    last[fp] = us
                    keep.append(at)
            if keep:
                yield rows.loc[keep, ["event_id", "ts", "fp"]]
        passed = state.getCurrentWatermarkMs()
        last = {fp: us for fp, us in last.items() if (us + delay) // 1000 + 1 > passed}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp((min(last.values()) + delay) // 1000 + 1)
        elif state.exists:
            state.remove()

    marked = events.select("event_id", "ts", "fp", F.pmod(F.xxhash64("fp"), F.lit(buckets)).alias("bucket")).withWatermark("ts", f"{delay_seconds} seconds")
    return marked.groupBy("bucket").applyInPandasWithState(judge, KEPT, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def in_arrival_order(events: DataFrame, slices: int) -> str:
    """``events`` as files that a stream reads in order of time: ``slices`` of
    equal length, one after the other. For inputs whose files are in no order.
    All tasks deal the events out to the slices at once; each slice is then
    copied into its file."""
    spark, dealt, out = events.sparkSession, scratch_path(events.sparkSession, "slices"), scratch_path(events.sparkSession, "arrivals")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    later = [F.when(F.col("ts") >= F.lit(lo + (hi - lo) * k / slices), 1).otherwise(0) for k in range(1, slices)]
    events.where("ts IS NOT NULL").withColumn("slice", sum(later, F.lit(0))).write.partitionBy("slice").parquet(dealt)
    for i in range(slices):
        part = spark.read.schema(T.StructType(events.schema.fields + [T.StructField("slice", T.IntegerType())])).parquet(dealt).where(F.col("slice") == i)
        part.drop("slice").coalesce(1).write.mode("append").parquet(out)
    return out


def stream_dedup_expiring(spark: SparkSession, sf_dir: str, delay_seconds: int = 3600, slices: int = 6, progress: list | None = None) -> DataFrame:
    """L3 over the events in order of time, one slice a micro-batch, state in RocksDB."""
    events = event_time(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")).withColumn("fp", event_fingerprint()).select("event_id", "ts", "fp")
    arrivals = in_arrival_order(events, slices)
    s = spark.readStream.schema(KEPT).option("maxFilesPerTrigger", 1).parquet(arrivals)
    with state_store(spark):
        out = run_available_now(expiring_dedup(s, delay_seconds), "stream-expiring", progress=progress)
    return spark.read.schema(KEPT).parquet(out)


def window_counts(rows: DataFrame, kind: str, window: str, delay: str, progress: list | None = None) -> DataFrame:
    """L4: counts of ``rows(ts, <kind>)`` per tumbling window, open windows
    included. Each micro-batch commits the windows that it changed as rows of
    its own; the table is never rewritten, and a batch that is replayed after a
    failure is there already. The count of a window is that of the last batch
    which changed it. State holds the windows the watermark has not passed;
    events later than ``delay`` are dropped."""
    agg = rows.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    counts = agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), kind, "n")
    schema = f"window_start string, {kind} string, n long, batch long"

    def changed(batch: DataFrame, batch_id: int, out: str) -> None:
        commits.commit(batch.withColumn("batch", F.lit(batch_id).cast("long")), out, f"{batch_id:012d}")

    out = run_available_now(counts, "stream-counts", "update", batch_fn=changed, progress=progress)
    return latest_counts(commits.committed(rows.sparkSession, out, schema), kind)


def latest_counts(changes: DataFrame, kind: str) -> DataFrame:
    """The last count of each window and kind."""
    return changes.groupBy("window_start", kind).agg(F.max_by("n", "batch").alias("n"))


def stream_window_counts(spark: SparkSession, sf_dir: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """L4 (extension): event counts per tumbling window and type."""
    return window_counts(event_time(read_stream(spark, sf_dir, "events")).select("ts", "event_type"), "event_type", window, delay)


def stream_verdict_counts(messages: DataFrame, window: str = "1 day", rule_set: str = "v4", delay: str = "1 day",
                          progress: list | None = None) -> DataFrame:
    """L4: per tumbling window of ``messages(ts, text)``, a stream, the messages
    of each verdict and the hits of each rule; open windows included."""
    found = classify(messages, rule_set)
    kinds = F.concat(F.array(F.concat(F.lit("verdict:"), F.col("verdict"))),
                     F.transform("matches", lambda m: F.concat(F.lit("rule:"), m)))
    return window_counts(found.select("ts", F.explode(kinds).alias("kind")), "kind", window, delay, progress)


def winner_config() -> dict:
    """The configuration the router serves (v4 winner: llama3.2:3b, prompt G)."""
    return next(c for c in P.default_configs() if c["model"] == "llama3.2:3b" and c["prompt_name"].startswith("G:"))
