"""Labelled cases (A1) and source-provenance helpers (A3-A5) on the driver
tables.

Gold labels on driver data are a *mechanical stand-in*: ``labels.toxic = 1``
counts as SENSITIVE. Rates computed on them say nothing about privacy quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.joins import join_small, spread
from veilspark.sources.tables import table


def source_rank_of(source: Column) -> Column:
    """Priority of a driver ``source`` tag ``srcN`` = N (lower wins)."""
    return F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")


def gold_label(toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit("SENSITIVE")).otherwise(F.lit("PUBLIC"))


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cases(case_id, text, label, source, source_rank, lang) =
    documents JOIN labels; labels is broadcast only if its estimated size is
    within the limit (at scale it is a regular shuffle join)."""
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    j = join_small(docs, labels, "doc_id", "inner")
    return j.select(F.col("doc_id").alias("case_id"), "text", gold_label(F.col("toxic")).alias("label"),
                    "source", source_rank_of(F.col("source")).alias("source_rank"), "lang")
