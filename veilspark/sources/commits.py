"""Batches of rows committed to a folder, each once and as a whole.

A batch is first written as an *attempt* in a folder of its own. An empty marker
file, named by batch, content and attempt, then commits it; creating one file is
atomic on every file system Spark writes to. Readers list the markers and read
the attempts they name, so an attempt that died half-way is never seen and
nothing committed is ever overwritten. A batch that comes again with the same
content changes nothing; other content under a known batch id is an error.

If two writers commit the same batch at the same moment there are two markers;
readers take the one whose attempt sorts first, so the batch counts once.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ID = re.compile(r"[A-Za-z0-9._-]+")


class OtherContent(ValueError):
    """A batch id is committed with different rows."""


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def markers(spark: SparkSession, store: str) -> dict[str, tuple[str, str]]:
    """batch id -> (content, attempt) of every committed batch."""
    fs, path = _folder(spark, f"{store}/commits")
    found: dict[str, tuple[str, str]] = {}
    for name in sorted(s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else [])):
        batch_id, content, attempt = name.split("=")
        found.setdefault(batch_id, (content, attempt))
    return found


def content_of(rows: DataFrame) -> str:
    """A fingerprint of the rows, whatever their order and files."""
    one = rows.select(F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)").alias("h"))
    n, total = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}_{total}".replace("-", "m")


def new_attempt() -> str:
    return uuid.uuid4().hex


def is_new(spark: SparkSession, store: str, batch_id: str, content: str) -> bool:
    """False if the batch is committed with this content; an error if with other."""
    if not BATCH_ID.fullmatch(batch_id):
        raise ValueError(f"batch id {batch_id!r} has characters other than letters, digits, '.', '_' and '-'")
    known = markers(spark, store).get(batch_id)
    if known and known[0] != content:
        raise OtherContent(f"batch {batch_id} is committed with other rows")
    return known is None


def publish(spark: SparkSession, store: str, batch_id: str, content: str, attempt: str) -> None:
    """Commit an attempt that is written."""
    fs, path = _folder(spark, f"{store}/commits/{batch_id}={content}={attempt}")
    fs.mkdirs(path.getParent())
    fs.createNewFile(path)


def commit(rows: DataFrame, store: str, batch_id: str) -> bool:
    """Write ``rows`` and commit them as ``batch_id``; False where the same batch
    is there already."""
    spark, attempt = rows.sparkSession, new_attempt()
    if not BATCH_ID.fullmatch(batch_id):
        raise ValueError(f"batch id {batch_id!r} has characters other than letters, digits, '.', '_' and '-'")
    path = f"{store}/data/{attempt}"
    rows.write.parquet(path)
    content = content_of(spark.read.schema(rows.schema).parquet(path))
    if not is_new(spark, store, batch_id, content):
        return False
    publish(spark, store, batch_id, content, attempt)
    return True


def committed(spark: SparkSession, store: str, schema, batches: list[str] | None = None) -> DataFrame:
    """Rows of all committed batches, or of those named."""
    found = markers(spark, store)
    paths = [f"{store}/data/{attempt}" for batch_id, (_, attempt) in found.items() if batches is None or batch_id in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
