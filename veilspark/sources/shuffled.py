"""A corpus kept on disk in seeded shuffled order.

Rows are dealt to files by ranges of their seeded hash. The ranges are whole
hash buckets (``16 ** prefix_len``, a bound known in advance), cut where the
running count passes a multiple of ``rows_per_file``; only ids are read for the
counts. The rows are then shuffled once, by file, and sorted inside their file.
A file's folder is named by the number of rows before it, so names in order give
the shuffled order, and a row's ordinal is that number plus its place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.splits import seeded_hash
from veilspark.session import scratch_path

START = "rows_before"
DIGITS = 15


def file_starts(ids: DataFrame, rows_per_file: int, prefix_len: int) -> DataFrame:
    """``_b, rows_before`` for every hash bucket that has rows: the number of rows
    before the file its rows go to. Windows run over at most ``16 ** prefix_len`` rows."""
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    files = Window.partitionBy(F.floor(F.col("_off") / rows_per_file))
    return offsets.select("_b", F.lpad(F.min("_off").over(files).cast("string"), DIGITS, "0").alias(START))


def write_shuffled(corpus: DataFrame, path: str | None = None, id_col: str = "case_id", seed: int | str = 42,
                   rows_per_file: int = 1_000_000, prefix_len: int = 4) -> DataFrame:
    """Write ``corpus`` in the order of (seeded hash, id) and return it as
    ``read_shuffled`` does. Ids are unique (rows that share one stand in any order,
    side by side). ``corpus`` is read twice, for its ids and as a whole: land a dear
    one first. A file has up to ``rows_per_file`` rows and those of one bucket more."""
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "shuffled")
    keyed = corpus.withColumn("_h", seeded_hash(F.col(id_col), seed)).withColumn("_b", F.substring("_h", 1, prefix_len))
    starts = file_starts(keyed.select("_b"), rows_per_file, prefix_len)
    dealt = keyed.join(F.broadcast(starts), "_b").repartition(START).sortWithinPartitions(START, "_h", id_col)
    dealt.select(*corpus.columns, START).write.option("maxRecordsPerFile", 0).partitionBy(START).parquet(path)
    return read_shuffled(spark, path, corpus.schema)


def read_shuffled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows below ``path`` with ``ordinal``, gapless from 1 in shuffled order,
    taken from where a row lies: rows before its file, and its place in it."""
    whole = T.StructType([*schema.fields, T.StructField(START, T.LongType())])
    rows = spark.read.schema(whole).parquet(path)
    return rows.select(*schema.names, (F.col(START) + F.col("_metadata.row_index") + 1).alias("ordinal"))


def slice_of(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with ordinals ``first`` to ``last`` of what ``read_shuffled`` gives."""
    return rows.where(F.col("ordinal").between(first, last))
