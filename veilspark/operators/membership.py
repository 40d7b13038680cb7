"""Evaluation sets as bitmaps of case ordinals.

The cascade's answers are kept as one bitmap for each (configuration, label,
answer, scorer asked or not), every evaluation set as one too. The confusion
counts of any set, also one defined after the run, are the sizes of
intersections: neither the cascade nor the texts are touched again.

A bitmap is cut into blocks of 32,768 ordinals (4 KB). Rows are shuffled once, by
block, before their bits are set, so the blocks of a bitmap are made where all its
rows meet, and no task sends out a block for a few bits. Ordinals are dense
numbers of the cases (an id without large gaps, or the rank of ``exact_rank``);
sparse ones give the same counts from more blocks. A null ordinal is in no set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.answers import PUBLIC, SENSITIVE
from veilspark.operators.evaluate import _pct, rate

CELL = ["config_id", "label", "predicted", "asked"]


def bitmaps(rows: DataFrame, by: list[str], ordinal: str = "case_id") -> DataFrame:
    """``by..., block, bits``: the ordinals of each group, an ordinal that repeats once."""
    at = F.col(ordinal).cast("long")
    bits = rows.where(at.isNotNull()).select(*by, F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("_bit"))
    return bits.repartition("block").groupBy(*by, "block").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def outcome_cells(pred: DataFrame, ordinal: str = "case_id") -> DataFrame:
    """The bitmaps of a run's predictions (config_id, label, predicted, latency_ms)."""
    asked = F.coalesce(F.col("latency_ms"), F.lit(0.0)) > 0
    return bitmaps(pred.withColumn("asked", asked), CELL, ordinal)


def overlaps(cells: DataFrame, sets: DataFrame, cell_keys: list[str], set_keys: list[str]) -> DataFrame:
    """``cell_keys..., set_keys..., n``: how many ordinals each cell shares with each
    set. Pairs without any are left out."""
    keys = [*cell_keys, *set_keys]
    met = cells.join(sets.withColumnRenamed("bits", "_other"), "block")
    both = met.select(*keys, "block", F.explode(F.array("bits", "_other")).alias("bits"))
    shared = both.groupBy(*keys, "block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("_n"))
    return shared.groupBy(*keys).agg(F.sum("_n").alias("n")).where("n > 0")


def set_metrics(cells: DataFrame, sets: DataFrame, set_keys: tuple[str, ...] = ("eval_set",)) -> DataFrame:
    """F2 to F4 (definition v1) of every configuration on every set. Latencies are
    sums over cases, which a set's membership alone does not give."""
    n, label, answer = F.col("n"), F.col("label"), F.col("predicted")
    ok, leak = answer == label, (label == SENSITIVE) & (answer == PUBLIC)

    def count(of, name):
        return F.sum(F.when(of, n).otherwise(0)).alias(name)

    counts = overlaps(cells, sets, CELL, list(set_keys)).groupBy(*set_keys, "config_id").agg(
        F.sum(n).alias("total"), count(label == SENSITIVE, "n_sensitive"), count(label == PUBLIC, "n_public"), count(ok, "correct"),
        count(leak, "false_negatives"), count(~ok & ~leak, "false_positives"), count(F.col("asked"), "llm_calls"))
    shares = (("accuracy", "correct", "total"), ("fnr", "false_negatives", "n_sensitive"), ("fpr", "false_positives", "n_public"))
    return counts.select("*", *[rate(F.col(a), F.col(b)).alias(name) for name, a, b in shares],
                         *[_pct(F.col(a), F.col(b)).alias(f"{name}_pct") for name, a, b in shares])
