"""Token counts as delta-maintained rollups.

A change to a document's count is an insert, a delete or a revision. Each turns
into signed rows: +count under its key for what begins to hold, -count for what
ceases to. A batch of changes is summed by (source, lang, tokenizer) before and
after the shuffle, and its few sums are committed under the batch's id by one
marker (``sources.commits``): a batch that died half-way is not seen, a retried or
repeated batch counts once, and other sums under a committed id are an error.
Totals are the sums over all committed batches, so they never need the documents
again.

Defined cases: null sources and languages are groups of their own; null texts
have no tokens but count as documents; ids take no part in the sums, so
repeated rows count each; keys whose documents are all gone disappear from the
totals; empty batches commit nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources import commits

from . import tokens

KEY = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokens long"


def count_tokens(docs: DataFrame, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """``doc_id, source, lang, text_md5, tokenizer, n_tokens`` for each row and
    tokenizer version; each text is read once."""
    columns = ["doc_id", "source", "lang", "text_md5"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {name: tokens.load(name, folder) for name in tokenizers}
        for batch in batches:
            at = 0
            for texts in tokens.slices(batch.column("text")):
                kept = [batch.column(c).slice(at, len(texts)) for c in columns]
                at += len(texts)
                for name, model in models.items():
                    made = [*kept, pa.array([name] * len(texts), pa.string()), pa.array(model.count(texts), pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, [*columns, "tokenizer", "n_tokens"])

    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text", F.md5("text").alias("text_md5"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, text_md5 string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit("insert").alias("op"), *KEY, "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit("delete").alias("op"), "tokenizer", F.col("source").alias("old_source"),
                         F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"))


def revisions(counts: DataFrame, n_tokens) -> DataFrame:
    """The same documents with ``n_tokens`` (a column) instead of their count."""
    return counts.select(F.lit("revise").alias("op"), *KEY, n_tokens.cast("long").alias("n_tokens"),
                         F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Rows of ``DELTAS``: what each change adds and takes away."""
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CHANGES.split(", ") if c.split()[0] not in changes.columns}
    changes = changes.withColumns(nothing) if nothing else changes
    added = F.when(F.col("op").isin("insert", "revise"), F.struct(
        F.col("source"), F.col("lang"), F.col("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens")))
    taken = F.when(F.col("op").isin("delete", "revise"), F.struct(
        F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("tokenizer"),
        F.lit(-1).cast("long").alias("n_docs"), (-F.col("old_tokens")).alias("n_tokens")))
    return changes.select(F.explode(F.array(added, taken)).alias("d")).where("d is not null").select("d.*")


def add_up(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def commit(changes: DataFrame, store: str, batch_id: str) -> bool:
    """Sum a batch and commit it under its id; False if it is committed already."""
    return commits.commit(add_up(signed(changes)).select(*[c.split()[0] for c in DELTAS.split(", ")]), store, batch_id)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches."""
    return add_up(commits.committed(spark, store, DELTAS)).where("n_docs <> 0 or n_tokens <> 0")
