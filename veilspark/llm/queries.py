"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.session import scratch_path
from veilspark.sources.tables import table

from . import (decontaminate, filter_audit, line_dedup, mixing, near_dedup, packing, quality, rollups, secrets, sharding,
               topk, warc, whitening)
from .common import land
from .sql import ORACLES  # noqa: F401


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_text")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under both tokenizer versions; exact copies
    of a document with a smaller id are deleted; documents labelled toxic have
    their counts revised to 0; the second batch is committed twice. Documents
    without an id are inserted and then neither deleted nor revised."""
    counts = land(rollups.count_tokens(table(spark, sf_dir, "documents"), ["word_bpe_49k", "byte_bpe_50k"]), "token-counts")
    first = counts.groupBy(F.col("text_md5").alias("_md5")).agg(F.min("doc_id").alias("_first"))
    kept = counts.join(first, F.col("text_md5").eqNullSafe(F.col("_md5")))
    copies, own = kept.where("doc_id <> _first"), kept.where("doc_id = _first")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    batches = {"1": rollups.inserts(counts.where("tokenizer = 'word_bpe_49k'")), "2": rollups.inserts(counts.where("tokenizer = 'byte_bpe_50k'")),
               "3": rollups.deletes(copies), "4": rollups.revisions(own.join(toxic, "doc_id", "left_semi"), F.lit(0))}
    store = scratch_path(spark, "token-rollups")
    for batch_id in ("1", "2", "3", "2", "4"):
        rollups.commit(batches[batch_id], store, batch_id)
    return rollups.totals(spark, store)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_secrets, op3_decontamination, op4_topk, op5_token_rollups, op6_quality, op7_near_dedup, op8_packing, op9_warc,
                            op10_line_dedup, op11_filter_audit, op12_mixing, op13_whitening)
} | {"pipeline": corpus_pipeline.run}
