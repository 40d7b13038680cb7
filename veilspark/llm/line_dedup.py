"""Line dedup: explode the lines, hash their normalised form, count distinct
documents per hash, drop lines over the threshold, reassemble by position.

A line's key is the line without ASCII white space at either end and with A-Z
lower-cased. Keys of ``min_chars`` code points or more that occur in
``min_docs`` documents or more lose all their lines, except in the largest
``doc_id`` that holds them.

Counting is pre-aggregated before the shuffle, so a line that a third of all
documents share arrives as one row per task. Only hashes and positions are
joined with the counts; the lines of a document travel once, to meet the list
of positions it loses.

Defined cases: a null text is one empty line and stays null when nothing is
dropped; rows with one ``doc_id`` count as one document, and each row keeps its
own lines (rows are told apart by id and text, equal rows get equal results);
null ids count as no document and are never the keeper; empty tables give empty
results; other columns pass through untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``doc_id, _text, _drops``: for each row that loses lines, their positions."""
    text = whole_text()
    lines = docs.select("doc_id", F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keys = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    found = keys.select("doc_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    common = (found.groupBy("_h1", "_h2").agg(F.countDistinct("doc_id").alias("_n"), F.max("doc_id").alias("_keeper"))
              .where(F.col("_n") >= min_docs).select("_h1", "_h2", "_keeper"))
    lost = found.join(common, ["_h1", "_h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("doc_id", "_text").agg(F.collect_set("_pos").alias("_drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept lines as ``text``, plus ``n_lines`` (before
    dropping) and ``n_dropped``; columns of these two names are replaced."""
    names = docs.columns
    drops = dropped_positions(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "_drops")
    rows = docs.withColumn("_text", F.xxhash64(whole_text())).withColumn("_null", F.col("text").isNull())
    rows = rows.withColumn("text", F.split(whole_text(), "\n", -1))  # an array from here on, so no lambda splits it again
    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("text") - 1), F.col("_drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("text"), i)), "\n")
    whole = F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(F.array_join("text", "\n"))
    out = [F.when(F.col("_drops").isNull(), whole).otherwise(kept).alias("text") if c == "text" else F.col(c)
           for c in names if c not in ("n_lines", "n_dropped")]
    return met.select(*out, F.size("text").cast("long").alias("n_lines"),
                      F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))
