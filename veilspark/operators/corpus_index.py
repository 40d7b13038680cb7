"""A corpus that grows batch by batch (E1, A5): the set of texts seen so far is
kept on disk, and a new batch of sources is deduplicated against it.

Kept in one folder: the corpus rows of each batch, an index of fingerprints as a
bucketed table, and a Bloom filter of each batch's fingerprints in blocks. All of
a batch's files carry its attempt, and one marker commits them together
(``sources.commits``): files of an attempt without a marker are never read.

A new batch is first reduced to the first row of each fingerprint. Fingerprints
that the blocks of the Bloom filter surely do not hold are new. Only the others are joined
with the index, by a merge join over its buckets: the batch's rows are dealt to
the buckets, the index is read where it lies and never shuffled.

Batches come in order of priority: what an earlier batch holds wins, as with the
growing set of the one-pass builder. A batch that is added again changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.cascade import land
from veilspark.operators.corpus import ORDER, first_wins
from veilspark.sources import commits

ROWS = "case_id long, text string, label string, source string, source_rank int, lang string, fp string"
BLOOM = "block int, bits binary, attempt string"
#: Bits of one block (Spark's bitmaps have this fixed size) and probes of a fingerprint.
BLOCK_BITS = 32768
PROBES = 3
MOST_BLOCKS = 4096


@dataclass(frozen=True)
class CorpusIndex:
    """``buckets`` and ``blocks`` are fixed when the folder is first used. A block
    serves some 3,000 fingerprints at ten bits each; with more, fewer new ones
    skip the join. ``blocks`` of 4 KB each are broadcast: at most MOST_BLOCKS."""
    store: str
    buckets: int = 64
    blocks: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.blocks <= MOST_BLOCKS:
            raise ValueError(f"blocks must be 1 to {MOST_BLOCKS}")

    @property
    def table(self) -> str:
        return "corpus_index_" + hashlib.md5(self.store.encode()).hexdigest()[:16]

    def open(self, spark: SparkSession) -> None:
        """Name the index's folder as a bucketed table of this session."""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (fp STRING, attempt STRING) USING parquet "
                  f"CLUSTERED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.store}/index'")
        spark.catalog.refreshTable(self.table)

    def attempts(self, spark: SparkSession) -> list[str]:
        return [attempt for _, attempt in commits.markers(spark, self.store).values()]

    def seen(self, spark: SparkSession) -> DataFrame:
        """Fingerprints of all committed batches."""
        self.open(spark)
        return spark.table(self.table).where(F.col("attempt").isin(self.attempts(spark))).select("fp")

    def corpus(self, spark: SparkSession) -> DataFrame:
        return commits.committed(spark, self.store, ROWS)


def places(fp: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block and bits of a fingerprint."""
    h = F.xxhash64(fp)
    block = F.pmod(F.shiftrightunsigned(h, 45), F.lit(blocks)).cast("int")
    return block, [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def bloom_of(fps: DataFrame, blocks: int) -> DataFrame:
    block, bits = places(F.col("fp"), blocks)
    return fps.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def split_by_bloom(rows: DataFrame, index: CorpusIndex) -> DataFrame:
    """``rows`` with ``_maybe``: false where no committed batch has the fingerprint."""
    spark, found = rows.sparkSession, index.attempts(rows.sparkSession)
    if not found:
        return rows.withColumn("_maybe", F.lit(False))
    kept = spark.read.schema(BLOOM).parquet(*[f"{index.store}/bloom/{a}" for a in found])
    merged = kept.groupBy("block").agg(F.bitmap_or_agg("bits").alias("_bits"))  # at most ``blocks`` rows of 4 KB
    block, bits = places(F.col("fp"), index.blocks)
    held = F.col("_bits").isNotNull()
    for bit in bits:
        byte = F.conv(F.hex(F.substr("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return rows.withColumn("block", block).join(F.broadcast(merged), "block", "left").withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("block", "_bits")


def unseen(rows: DataFrame, index: CorpusIndex) -> DataFrame:
    """Rows whose fingerprint the index does not hold; the index is not shuffled."""
    seen = index.seen(rows.sparkSession)
    dealt = rows.repartition(index.buckets, "fp")
    return dealt.join(seen.hint("merge"), "fp", "left_anti")


def add(rows: DataFrame, index: CorpusIndex, batch_id: str) -> bool:
    """Add a batch of candidate rows (columns of ``corpus.candidates``); False
    where the batch is in the corpus already. Other rows under a committed id are
    an error."""
    spark, attempt, names = rows.sparkSession, commits.new_attempt(), [c.split()[0] for c in ROWS.split(", ")]
    first = land(first_wins(rows, ["fp"], ORDER).select(*names), "batch-first")
    content = commits.content_of(first)
    if not commits.is_new(spark, index.store, batch_id, content):
        return False
    told = land(split_by_bloom(first, index), "batch-told")
    fresh = told.where("NOT _maybe").drop("_maybe").unionByName(unseen(told.where("_maybe").drop("_maybe"), index))
    path = f"{index.store}/data/{attempt}"
    fresh.select(*names).write.parquet(path)
    fps = spark.read.schema(ROWS).parquet(path).select("fp")
    index.open(spark)
    fps.withColumn("attempt", F.lit(attempt)).repartition(index.buckets, "fp").write.insertInto(index.table)
    bloom_of(fps, index.blocks).withColumn("attempt", F.lit(attempt)).write.parquet(f"{index.store}/bloom/{attempt}")
    commits.publish(spark, index.store, batch_id, content, attempt)
    return True
