"""Joins with an explicit size check before broadcasting, and scan spreading.
Both decide from the optimizer's estimates and file lists; neither runs a job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's size estimate is below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
SCAN_NODES = {"Project", "Filter", "Union", "Relation", "LogicalRelation"}


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (file sizes, pruned
    columns, filter selectivity)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Join ``big`` with ``small``; broadcast ``small`` only if its estimated
    size is within ``limit``. Beyond it the plan is a regular shuffle join
    (sort-merge, AQE may still convert or split skewed partitions)."""
    if estimated_bytes(small) <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def spread(scan: DataFrame) -> DataFrame:
    """Spread CPU-bound work (regex rules over long texts) over all cores when
    a scan yields fewer partitions than the cluster's parallelism, e.g. a
    single small file. Decided from the number and size of the files; frames
    that are more than a scan (a join, an aggregate) are left as they are."""
    if scan.isStreaming:
        return scan
    spark = scan.sparkSession
    nodes = re.findall(r"^[\s:+-]*(\w+)", scan._jdf.queryExecution().optimizedPlan().toString(), re.M)
    if not set(nodes) <= SCAN_NODES:
        return scan
    want = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    have = max(len(scan.inputFiles()), estimated_bytes(scan) // split)
    return scan.repartition(want) if have < want else scan
