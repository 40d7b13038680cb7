"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.session import scratch_path


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def small_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A driver-made table whose size a parameter bounds, as one literal (no
    Python worker takes part in reading it)."""
    kind = T.ArrayType(schema)
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
