"""Benchmark decontamination by spaced-seed hashing.

Texts are cut into lower-case alphanumeric tokens. A spaced seed hashes three
tokens at most ``REACH`` apart and ignores those between, so substituted words
do not hide a copied passage. All ten such masks are used: of half of an item's
tokens, wherever they lie, three are always that near to each other (tokens 0
and 1, 5 and 6, 10 and 11 of 12 are the worst case), so no item that agrees in
half of its tokens is missed at any place of the substitutions. For a
``min_overlap`` under one half this does not hold.

Benchmark seeds are joined with those of the training texts. Hits only name a
document, an item and a diagonal (the offset between them); where there are as
many as ``min_overlap`` implies at least (``least_seeds``), the whole item is
compared with the document's tokens along that diagonal. A document holds an
item of ``SPAN`` tokens or more

* if on one diagonal at least ``min_overlap`` of the item's tokens agree,
* if on one diagonal ``RUN`` consecutive tokens agree, however long the item is,
* or if runs of ``PIECE`` tokens or more, on diagonals at most the item's length
  apart, make up ``min_overlap`` of it: a copy with words put in or left out.

A shorter item is held where its whole token sequence is found. Letters of
scripts without spaces between words are tokens of their own.

The first two tokens of a seed filter the windows of the corpus before the
third is taken. The benchmark's tables are broadcast if their landed size is
within the checked limit; beyond that the same joins run shuffled. Texts are
read again for documents with such diagonals. No pair of documents is formed.

Defined cases: null texts and ids are read as empty text and as an id of their
own; texts without tokens hold nothing and are held by nothing; repeated documents or items give one row per distinct pair of ids; empty tables
give empty results; extra columns are ignored (``without_leaks`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.joins import join_small

from .common import land, whole_text

SPAN = 10
REACH = 5
MIN_OVERLAP = 0.5
RUN = 13
PIECE = 5
#: Seeds of a run of PIECE tokens: each diagonal with one is compared.
PIECE_SEEDS = 10
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def token_hashes(text: Column) -> Column:
    apart = F.when(F.regexp_like(text, F.lit(UNSPACED)), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    words = F.array_remove(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def document_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), whole_text())


def windows(rows: DataFrame, keys: list[str], width: int = REACH + 1) -> DataFrame:
    """A row for each token: ``keys``, ``_at`` and the ``width`` tokens from there
    on as ``_t0``.. (null past the end)."""
    tokens = F.col("_tokens")
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0))).alias(f"_t{k}") for k in range(width)]
    at = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(*keys, F.inline(F.arrays_zip(at.alias("_at"), *shifted)))


def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each window and second position but the last: its ``_pair`` hash."""
    made = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_t{i}").alias("_ti"),
                              F.when(F.col(f"_t{i}").isNotNull(), F.xxhash64(F.lit(i), "_t0", f"_t{i}")).alias("_pair")) for i in range(1, REACH)])
    return rows.select(*keys, "_at", *[f"_t{k}" for k in range(REACH + 1)], F.inline(made)).where(F.col("_pair").isNotNull())


def seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each of ``pairs`` and third position after the second: ``keys, _at, _seed``."""
    made = F.array(*[F.when((F.col("_i") < j) & F.col(f"_t{j}").isNotNull(), F.xxhash64(F.lit(j), "_i", "_t0", "_ti", f"_t{j}"))
                     for j in range(2, REACH + 1)])
    return rows.select(*keys, "_at", F.explode(made).alias("_seed")).where(F.col("_seed").isNotNull())


def whole_seeds(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """A row for each window and length of short items: ``keys, _at, _seed``."""
    made = F.array(*[F.struct(F.lit(n).alias("_length"), F.when(F.col(f"_t{n - 1}").isNotNull(), F.xxhash64(F.lit(-n), *[f"_t{k}" for k in range(n)])).alias("_seed"))
                     for n in lengths])
    return rows.select(*keys, "_at", F.inline(made)).where(F.col("_seed").isNotNull())


def least_seeds(tokens: Column, min_overlap: float) -> Column:
    """Seeds that ``min_overlap`` of an item's tokens hold on a diagonal, wherever they
    lie: k of n positions fill the n + REACH windows of REACH + 1 with 6 k, so these
    hold 6 k - 2 (n + 5) triples or more, and a triple is in four windows at most. A
    run of ``PIECE`` tokens has ``PIECE_SEEDS``."""
    agreeing = F.ceil(min_overlap * tokens - 1e-9)
    least = F.greatest(F.lit(1), F.ceil((6 * agreeing - 2 * (tokens + REACH)) / 4))
    return F.least(least, F.lit(PIECE_SEEDS)).cast("long")


def along_diagonals(docs: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc_id, _text, item_id, item_tokens, _diagonal, _agree``: for each row of
    ``candidates(_doc, _item, item_tokens, _diagonal)`` the whole item compared with the
    document's tokens, as a string of 1 and 0 by position in the item."""
    asked = candidates.groupBy("_doc").agg(F.collect_list(F.struct("_item", "item_tokens", "_diagonal")).alias("_asked"))
    asked = land(asked, "diagonals")
    read = docs.select("doc_id", whole_text().alias("text"), document_key().alias("_doc"))
    read = join_small(read, asked, "_doc").select("doc_id", F.xxhash64("text").alias("_text"), token_hashes(F.col("text")).alias("_all"), "_asked")

    def part(c: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), c["item_tokens"] - 1), lambda i: F.get("_all", c["_diagonal"] + i))
        return F.struct(c["_item"].alias("_item"), c["_diagonal"].alias("_diagonal"), own.alias("_own"))

    parts = read.select("doc_id", "_text", F.inline(F.transform("_asked", part)))
    agree = F.transform(F.arrays_zip(F.col("_own").alias("a"), F.col("_tokens").alias("b")), lambda p: F.when(p["a"] == p["b"], "1").otherwise("0"))
    return join_small(parts, items, "_item").select("doc_id", "_text", "item_id", "item_tokens", "_diagonal", F.array_join(agree, "").alias("_agree"))


def nearby_pieces(found: DataFrame) -> DataFrame:
    """``doc_id, _text, item_id, item_tokens, matched, _first``: for each document and
    item the tokens in runs of ``PIECE`` or more on nearby diagonals, each counted
    once in the item and in the document. Diagonals are put in stretches of twice
    the item's length that overlap by half, so those at most its length apart meet."""
    starts = F.filter(F.sequence(F.lit(0), F.col("item_tokens") - PIECE), lambda i: F.substr("_agree", i + 1, F.lit(PIECE)) == "1" * PIECE)
    places = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + PIECE - 1))))
    stretch = F.floor(F.col("_diagonal") / F.col("item_tokens"))
    runs = found.where(F.col("_agree").contains("1" * PIECE)).withColumn("_place", F.explode(places))
    runs = runs.withColumn("_stretch", F.explode(F.array(stretch, stretch - 1)))
    own = ["doc_id", "_text", "item_id", "item_tokens", "_stretch"]
    in_item = runs.groupBy(*own, "_place").agg(F.min(F.col("_diagonal") + F.col("_place")).alias("_first")).groupBy(*own).agg(
        F.count(F.lit(1)).alias("_of_item"), F.min("_first").alias("_first"))
    in_doc = runs.select(*own, (F.col("_diagonal") + F.col("_place")).alias("_at")).distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("_of_doc"))
    met = in_item.alias("i").join(in_doc.alias("d"), [F.col(f"i.{c}").eqNullSafe(F.col(f"d.{c}")) for c in own])
    return met.select(*[f"i.{c}" for c in own[:-1]], F.least("_of_item", "_of_doc").alias("matched"), "_first")


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """``doc_id, _text, item_id, first_token, matched, item_tokens, overlap``:
    for each row of ``docs(doc_id, text)`` and item found in it the best
    diagonal, or nearby diagonals together where these hold more. ``_text`` (a
    hash) tells rows with one id apart."""
    items = (benchmark.select("item_id", token_hashes(whole_text()).alias("_tokens"))
             .where(F.size("_tokens") > 0).withColumn("item_tokens", F.size("_tokens"))
             .withColumn("_item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "_tokens")))
    items = land(items.dropDuplicates(["_item"]), "items")
    lengths = sorted(r["item_tokens"] for r in items.where(F.col("item_tokens") < SPAN).select("item_tokens").distinct().collect())
    own = ["_item", "item_tokens"]
    known = land(pairs(windows(items.where(F.col("item_tokens") >= SPAN), own), own), "pairs")
    read = docs.select(document_key().alias("_doc"), token_hashes(whole_text()).alias("_tokens"))
    near = join_small(pairs(windows(read, ["_doc"]), ["_doc"]), known.select("_pair").distinct(), "_pair", "left_semi")
    known = seeds(known, own).withColumnRenamed("_at", "_item_at").withColumn("_least", least_seeds(F.col("item_tokens"), min_overlap))
    hits = join_small(seeds(near, ["_doc"]), land(known, "seeds"), "_seed")
    candidates = (hits.groupBy("_doc", "_item", "item_tokens", "_least", (F.col("_at") - F.col("_item_at")).alias("_diagonal"))
                  .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= F.col("_least")).select("_doc", *own, "_diagonal"))
    if lengths:
        short = whole_seeds(windows(items.where(F.col("item_tokens") < SPAN), own, lengths[-1]), own, lengths)
        short = land(short.where(F.col("_length") == F.col("item_tokens")).select("_seed", *own), "short-seeds")
        of_docs = whole_seeds(windows(read, ["_doc"], lengths[-1]), ["_doc"], lengths).drop("_length")
        candidates = candidates.unionByName(join_small(of_docs, short, "_seed").groupBy("_doc", *own).agg(F.min("_at").alias("_diagonal")))

    found = land(along_diagonals(docs, items, candidates), "compared")
    found = found.withColumn("matched", F.char_length(F.replace("_agree", F.lit("0"), F.lit(""))).cast("long"))
    enough = F.col("matched") >= min_overlap * F.col("item_tokens")
    one = (found.where(F.when(F.col("item_tokens") < SPAN, F.col("matched") == F.col("item_tokens")).otherwise(enough | F.col("_agree").contains("1" * RUN)))
           .withColumn("_first", F.col("_diagonal") + F.instr("_agree", "1") - 1))
    some = nearby_pieces(found.where(F.col("item_tokens") >= SPAN)).where(enough)
    columns = ["doc_id", "_text", "item_id", "item_tokens", "matched", "_first"]
    best = (one.select(*columns, F.lit(1).alias("_one")).unionByName(some.select(*columns, F.lit(0).alias("_one")))
            .groupBy("doc_id", "_text", "item_id")
            .agg(F.max(F.struct("matched", "_one", (-F.col("_first")).alias("_back"), "item_tokens")).alias("_best")))
    return best.select("doc_id", "_text", "item_id", (-F.col("_best")["_back"]).cast("long").alias("first_token"),
                       F.col("_best")["matched"].alias("matched"), F.col("_best")["item_tokens"].cast("long").alias("item_tokens"),
                       (F.col("_best")["matched"] / F.col("_best")["item_tokens"]).alias("overlap"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    leaks = find_leaks(docs, benchmark, min_overlap).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(whole_text()) == F.col("_of"))
    return docs.join(leaks, match, "left_anti")
