"""Sinks (A6-A8): corpus and result records to the shared folder.

Paths default to fresh folders under ``spark.checkpoint.dir`` (shared by the
cluster); callers pass a real destination in production.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import scratch_path


def write_corpus(corpus: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """One folder per split (``partitionBy("split")``); quoting/escaping
    concerns of the reference's Python-module output disappear."""
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "corpus")
    corpus.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def write_results(metrics: DataFrame, misses: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One record a configuration, and every miss as a row of a table
    beside it (JSON both); the metrics alone are the slim record."""
    spark = metrics.sparkSession
    base = path or scratch_path(spark, "results")
    metrics.write.mode("overwrite").json(f"{base}/metrics")
    misses.write.mode("overwrite").json(f"{base}/misses")
    return (spark.read.schema(metrics.schema).json(f"{base}/metrics"),
            spark.read.schema(misses.schema).json(f"{base}/misses"))


def write_best_config(best: DataFrame, path: str | None = None) -> DataFrame:
    """The winning configuration with its metrics, as JSON."""
    spark = best.sparkSession
    path = path or scratch_path(spark, "best")
    best.write.mode("overwrite").json(path)
    return spark.read.schema(best.schema).json(path)


def write_routed(routed: DataFrame, path: str | None = None) -> DataFrame:
    """Routed messages, one folder a route."""
    spark = routed.sparkSession
    path = path or scratch_path(spark, "routed")
    routed.write.mode("overwrite").partitionBy("route").parquet(path)
    return spark.read.schema(routed.schema).parquet(path)
