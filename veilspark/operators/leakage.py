"""X1 (extension): which evaluation texts contain a prompt example / benchmark
passage verbatim (substring containment), as an equi-join.

A text holds a passage only if it holds the passage's *interior* tokens (all but
the first and last, which may be glued to neighbouring characters) as whole
consecutive tokens. A passage of three tokens or more is keyed by its first 1, 2,
4 or 8 interior tokens, the most it has; a text has one key a position for each
of these lengths. Keys of 2n tokens are made of two keys of n, so tokens are
hashed once. A passage of fewer tokens is keyed by its first three code points
(or all, if fewer), packed into one number; a text's keys are the same numbers for
its runs of one, two and three code points, each made of the run before.

So there is one branch, with seven keys a position at most, whatever lengths the
passages have, and the work is linear in the text. Keys pass a Bloom filter of
the passages' keys (a constant of ``FILTER_WORDS`` 64-bit words) before they
leave the row that holds the text; what is left is joined with the passages and
verified with ``contains``, which drops false hits of every kind. Kinds of key
that no passage has are not made. Where the passages are small enough to broadcast, texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.joins import BROADCAST_LIMIT_BYTES, estimated_bytes, spread

TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
LEVELS = 4  # keys of 1, 2, 4 and 8 tokens
FIRST_CHARS = 3
FILTER_WORDS = 1 << 12
FILTER_BITS = 6 + FILTER_WORDS.bit_length() - 1
PROBES = 2


def tokens(text):
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != F.lit(""))


def paired(keys: Column, apart: int) -> Column:
    """Keys of twice the length: each key with the one ``apart`` places on, as far
    as there is one. ``keys`` must be a column: a lambda would compute an
    expression anew for each element."""
    first = F.slice(keys, 1, F.greatest(F.size(keys) - apart, F.lit(0)))
    return F.zip_with(first, F.slice(keys, 1 + apart, F.size(keys)), lambda a, b: F.xxhash64(a, b))


def tagged(keys: Column, tag: Column) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(tag, k))


def rolled(values: Column, codes: Column, apart: int) -> Column:
    """Packed runs with the code point ``apart`` places on added, zero at the end."""
    return F.zip_with(values, F.slice(codes, 1 + apart, F.size(codes)),
                      lambda v, c: F.shiftleft(v, 21).bitwiseOR(F.coalesce(c, F.lit(0).cast("long"))))


def probes(key: Column) -> list[tuple[Column, Column]]:
    """Word and bit of a key, a hash, in the filter, ``PROBES`` times."""
    places = [F.shiftrightunsigned(key, 24 * i).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for i in range(PROBES)]
    return [(F.shiftrightunsigned(p, 6).cast("int"), p.bitwiseAND(F.lit(63)).cast("int")) for p in places]


def filter_of(keys: DataFrame) -> tuple[Column, list[int]]:
    """The Bloom filter of ``keys(key, kind)`` as a constant, and the kinds of key
    there are. FILTER_WORDS 64-bit words and at most seven kinds, whatever the
    number of keys, are all that comes to the driver."""
    places = keys.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in probes(F.col("key"))])).alias("p"))
    set_words = places.groupBy("p.w").agg(F.bit_or(F.expr("shiftleft(1L, p.b)")).alias("bits"))  # at most FILTER_WORDS rows
    kinds = keys.select(F.lit(-1).alias("w"), "kind").distinct()
    rows = set_words.unionByName(kinds.select("w", F.col("kind").cast("long").alias("bits"))).collect()
    found = {r["w"]: r["bits"] for r in rows if r["w"] >= 0}
    bits = F.split(F.lit(",".join(str(found.get(w, 0)) for w in range(FILTER_WORDS))), ",").cast("array<bigint>")
    return bits, sorted(r["bits"] for r in rows if r["w"] < 0)


def with_keys(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``_k0`` to ``_k3``, a key for each place and 1, 2, 4 and 8 tokens,
    and ``_r1`` to ``_r3``, the packed runs of 1, 2 and 3 code points from each place."""
    words = tokens(F.col(text))
    chars = F.filter(F.split(text, ""), lambda c: c != F.lit(""))
    rows = rows.withColumn("_k0", F.transform(words, lambda t: F.xxhash64(t))) \
        .withColumn("_c", F.transform(chars, lambda c: F.ascii(c).cast("long")))
    for i in range(1, LEVELS):
        rows = rows.withColumn(f"_k{i}", paired(F.col(f"_k{i - 1}"), 1 << (i - 1)))
    rows = rows.withColumn("_r1", F.col("_c"))
    for n in range(2, FIRST_CHARS + 1):
        rows = rows.withColumn(f"_r{n}", rolled(F.col(f"_r{n - 1}"), F.col("_c"), n - 1))
    return rows


def passage_keys(passages: DataFrame, passage_id: str) -> DataFrame:
    """``pid, ptext, key, kind``: kind is i for 2^i tokens, -n for n code points;
    empty passages have none."""
    rows = passages.select(F.col(passage_id).alias("pid"), F.col("text").alias("ptext")).where(F.length("ptext") > 0)
    rows = with_keys(rows, "ptext")
    inner = F.size("_k0") - 2
    kind = F.when(inner < 1, -F.least(F.size("_c"), F.lit(FIRST_CHARS)))
    for i in range(LEVELS):
        kind = kind.when(inner < 2 << i, i) if i < LEVELS - 1 else kind.otherwise(i)
    rows = rows.withColumn("kind", kind)
    own = F.lit(None).cast("long")
    for k, column, at in [(i, f"_k{i}", 1) for i in range(LEVELS)] + [(-n, f"_r{n}", 0) for n in range(1, FIRST_CHARS + 1)]:
        own = F.when(F.col("kind") == k, F.get(column, F.lit(at))).otherwise(own)  # tokens: from the second on
    return rows.select("pid", "ptext", F.xxhash64("kind", own).alias("key"), "kind")


def text_keys(bits: Column, kinds: list[int]) -> Column:
    """The different keys of ``kinds`` of a row of ``with_keys`` that pass the filter."""
    def held(key: Column) -> Column:
        test = F.lit(True)
        for word, bit in probes(key):
            test = test & (F.getbit(F.get(bits, word), bit) == 1)
        return test

    parts = [F.filter(tagged(F.col(f"_k{k}" if k >= 0 else f"_r{-k}"), F.lit(k)), held) for k in kinds]
    return F.array_distinct(F.concat(F.array().cast("array<bigint>"), *parts))


def contained_passages(texts: DataFrame, passages: DataFrame, text_id: str = "doc_id", passage_id: str = "item_id",
                       broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(text_id, passage_id) for every text containing a passage verbatim, once."""
    p = passage_keys(passages, passage_id)
    t = spread(texts).select(F.col(text_id).alias("tid"), F.col("text").alias("ttext"))
    bits, kinds = filter_of(p.select("key", "kind"))
    hits = with_keys(t.where("ttext IS NOT NULL"), "ttext").select("tid", "ttext", text_keys(bits, kinds).alias("keys"))
    # explode_outer: a filter on the keys (explode adds one) is pushed below the steps that make them, and repeats them
    if estimated_bytes(passages) <= broadcast_limit:
        found = hits.select("tid", "ttext", F.explode_outer("keys").alias("key")).join(F.broadcast(p.drop("kind")), "key")
    else:
        pairs = hits.select("tid", F.explode_outer("keys").alias("key")).join(p.select("key", "pid"), "key").select("tid", "pid").distinct()
        found = pairs.join(t, "tid").join(p.select("pid", "ptext"), "pid")
    return found.where(F.contains(F.col("ttext"), F.col("ptext"))) \
        .select(F.col("tid").alias(text_id), F.col("pid").alias(passage_id)).distinct()
