"""Filter interaction audit: what each filter removes under every order.

Filters over whole texts (words are maximal runs of non-blanks, case-sensitive):

* A: under 200 words;
* B: 100 * different words < 50 * words;
* C: 100 * letters A-Z > 2 * code points;
* D: holds one of ``#$%&*|``;
* E: identical to the text of a smaller doc_id, removed or not.

E alone needs other rows. A counting Bloom filter goes first: every text's 64-bit
hash names ``CELLS`` cells of one block, each task counts its own texts' cells up
to 2 and emits one sketch a block, and the sketches of a block are merged by
adding, again up to 2. A text with a cell counted once is unique beyond doubt and
is not shuffled. The others are grouped by their full text for the least doc_id,
partially before the shuffle, so copies held by a third of all rows collapse
where they are. What comes back is (digest, least id) of texts found twice.

A row's failures are five bits. Rows are counted by part and bits (and, for
labelled ones, by label), additively; 32 counts a part then give every one of the
120 orders: a filter's step in an order needs the bits before it only.

The merged sketch is broadcast: 1 bit a cell, ``PER_TEXT`` cells a text, at most
``MOST_CELLS`` cells (128 MB), full rate up to 64 million texts. With more texts
its cells fill up and it clears fewer of them; results do not depend on it.

Defined cases: a null text is empty; a null source is the empty string; a row
without doc_id never fails E and has no label; rows that repeat the least doc_id
of a text are all its first; a document labelled several times counts as good or
toxic if one label says so; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.joins import join_small

from .common import land, whole_text

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DIFFERENT = 50
MOST_CAPITALS = 2
BLANKS = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"

CELLS = 3
PER_TEXT = 16
BLOCK_BITS = 16  # a block holds 2^16 cells, 8 KB as bits
MOST_CELLS = 1 << 30
#: Cells that a task holds before it emits its sketch so far.
HELD_CELLS = 3 << 20
#: A repeated text's least id is joined under this many salts.
SALTS = 16


def blocks_for(texts: int) -> int:
    """Blocks (a power of two) with ``PER_TEXT`` cells a text, within the bound."""
    cells = min(MOST_CELLS, max(1 << BLOCK_BITS, PER_TEXT * texts))
    return 1 << max(0, (cells - 1).bit_length() - BLOCK_BITS)


def block_of(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(blocks - 1))


def cells_of(h: Column) -> list[Column]:
    """Places in the block: the hash's three lower runs of 16 bits."""
    return [F.shiftrightunsigned(h, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(CELLS)]


def twice(cells: np.ndarray) -> np.ndarray:
    """Sorted, each value at most twice: a sparse count up to 2."""
    cells = np.sort(cells)
    return np.delete(cells, np.flatnonzero(cells[2:] == cells[:-2]) + 2)


def sketch(texts: DataFrame, blocks: int) -> DataFrame:
    """``block, bits``: the merged sketch of ``texts(_h)``, a bit for each cell
    counted twice or more, as 64-bit words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            own = twice(held)
            block, first = np.unique(own >> BLOCK_BITS, return_index=True)
            cells = (own & ((1 << BLOCK_BITS) - 1)).astype("<u2")
            parts = [cells[a:b].tobytes() for a, b in itertools.pairwise([*first.tolist(), len(cells)])]
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(parts, pa.binary())], ["block", "cells"])

        held = np.empty(0, np.int64)
        for batch in batches:
            h = batch.column("_h").to_numpy().view(np.uint64)
            base = ((h >> np.uint64(48)) & np.uint64(blocks - 1)) << np.uint64(BLOCK_BITS)
            own = [base | ((h >> np.uint64(BLOCK_BITS * i)) & np.uint64((1 << BLOCK_BITS) - 1)) for i in range(CELLS)]
            held = np.concatenate([held, *[c.view(np.int64) for c in own]])
            if len(held) > HELD_CELLS:
                yield emit()
                held = np.empty(0, np.int64)
        if len(held):
            yield emit()

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << BLOCK_BITS, np.uint8)
        for part in parts:
            for cells in part["cells"]:
                counts = np.minimum(counts + np.bincount(np.frombuffer(cells, "<u2"), minlength=1 << BLOCK_BITS), 2).astype(np.uint8)
        bits = np.packbits(counts == 2, bitorder="little").view("<i8")
        yield pd.DataFrame({"block": [key[0]], "bits": [bits.tolist()]})

    parts = texts.mapInArrow(count, "block long, cells binary")
    return parts.groupBy("block").applyInPandas(merge, "block long, bits array<long>")


def maybe_repeated(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """``rows(_h, ...)`` with ``_maybe``: false for texts that are surely unique."""
    held = F.lit(True)
    for cell in cells_of(F.col("_h")):
        word = F.get("bits", F.shiftrightunsigned(cell, 6).cast("int"))
        held = held & (F.getbit(word, cell.bitwiseAND(F.lit(63)).cast("int")) == 1)
    # every block of a row's hash is in the sketch: the row itself is counted there
    return rows.withColumn("block", block_of(F.col("_h"), blocks)).join(F.broadcast(merged), "block") \
        .withColumn("_maybe", held).drop("block", "bits")


def repeated_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``_digest, _least`` of every text that several rows hold (least doc_id),
    and the sketch with its number of blocks."""
    texts = docs.select("doc_id", whole_text().alias("_text")).withColumn("_h", F.xxhash64("_text"))
    blocks = blocks_for(docs.count())
    merged = land(sketch(texts.select("_h"), blocks), "audit-sketch")
    some = maybe_repeated(texts, merged, blocks).where("_maybe")
    groups = some.groupBy("_text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return land(groups.select(F.sha2("_text", 256).alias("_digest"), "_least"), "audit-first"), merged, blocks


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails``: the filters that each row fails, as bits (A: 1,
    B: 2, C: 4, D: 8, E: 16)."""
    least, merged, blocks = repeated_texts(docs)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole_text().alias("_text")).withColumn("_h", F.xxhash64("_text"))
    split = F.filter(F.split("_text", BLANKS), lambda w: w != "")  # blanks at the ends leave empty strings
    rows = maybe_repeated(rows, merged, blocks).withColumn("_words", split)
    n = F.size("_words")
    own = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("_words")) < LEAST_DIFFERENT * n,
           100 * F.regexp_count("_text", F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length("_text"), F.rlike("_text", F.lit(SIGNS))]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own)), F.lit(0))
    flags = land(rows.select("doc_id", "part", bits.alias("fails"), F.when(F.col("_maybe"), F.sha2("_text", 256)).alias("_digest")), "audit-flags")
    salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    some = flags.where("_digest IS NOT NULL").withColumn("_salt", salt).join(salted, ["_digest", "_salt"], "left")
    late = F.when(F.col("doc_id") > F.col("_least"), 1 << FILTERS.index("E")).otherwise(0)
    again = some.select("doc_id", "part", (F.col("fails") + late).alias("fails"))
    return flags.where("_digest IS NULL").select("doc_id", "part", "fails").unionByName(again)


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, n, good, toxic``: additive counts, at most 32 rows a part."""
    of_label = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    zero = F.lit(0).cast("long")
    rows = failed.select("part", "fails", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    # rows of one id are counted before the join: a hot id is one row there
    ids = failed.where("doc_id IS NOT NULL").groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("_c"))
    labelled = join_small(ids, of_label, "doc_id").select(
        "part", "fails", zero.alias("n"), (F.col("_c") * F.col("good")).alias("good"), (F.col("_c") * F.col("toxic")).alias("toxic"))
    return rows.unionByName(labelled).groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders() -> Column:
    """Every order's steps: the order, the step, the step's filter and those
    before it as bits (600 structs)."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*steps)


def by_order(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from ``mask_counts``."""
    rows = counts.select("*", F.explode(orders()).alias("o")).select("part", "fails", "n", "good", "toxic", "o.*")
    fails = F.col("fails").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("fails").bitwiseAND(F.col("before")) != 0
    kept = F.col("fails").bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0
    # of the 120 orders, the filter comes first among a row's failures in 120 / failures
    first = F.floor(120 / F.bit_count("fails")) * F.col("n")
    told = {"kept": (kept, "n"), "removed": (fails & ~earlier, "n"), "redundant": (fails & earlier, "n"), "unique_fails": (F.col("fails") == F.col("bit"), "n"),
            "good_lost": (fails & ~earlier, "good"), "toxic_lost": (fails & ~earlier, "toxic"), "shapley": (fails, first)}
    sums = [F.sum(F.when(test, value if isinstance(value, Column) else F.col(value)).otherwise(0)).cast("long").alias(name)
            for name, (test, value) in told.items()]
    return rows.groupBy("part", "filter_order", "step").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts, 600 rows a part."""
    return by_order(land(mask_counts(failures(docs), labels), "audit-counts"))
