"""Secret scan: fixed patterns plus sliding-window Shannon entropy.

Base kinds, leftmost non-overlapping, positions in code points:

* ``assign``: a key word, ``:`` or ``=``, and a value of 6 characters or more;
* ``access``: ``AKIA`` and upper-case letters or digits, 20 characters or more;
* ``hex``: 24 lower-case hexadecimal digits or more.

The method adds candidate strings by character class (``CLASSES``, the narrow
alphabets first). A window of fixed width slides over the candidate, whose
characters are turned into symbol numbers once. The count of each symbol in the
window is kept up to date, a byte each, as one character enters and one leaves,
and with it the sum S of c * log2(c); the window's entropy is log2(w) - S / w.
The work is linear in the candidate. A candidate whose best window reaches the
class's threshold is a secret, unless a pattern of the allow list matches it or a
span found before already covers part of it. A candidate without a digit must
reach ``DIGIT_FREE_BITS``. Base spans are never suppressed. The thresholds let
through at most one in a hundred random keys of 24 symbols of the class's
alphabet.

All of it is column expressions: one pass over the table, no shuffle. Rows
without a match pay for the pattern scans only.

Defined cases: a null text is empty; no match gives zero counts and empty
strings; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Kind, pattern.
BASE = [
    ("assign", r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
]
ASSIGN_VALUE_CHARS = 6

# Kind, pattern of a candidate, its symbols, window width, threshold in bits.
WIDTH = 16
ALONE = r"(?<![A-Za-z0-9])[{}]{{16,}}(?![A-Za-z0-9])"  # no part of a longer run of letters and digits
CLASSES = [
    ("entropy_hex", ALONE.format("0-9A-Fa-f"), string.hexdigits, WIDTH, 2.95),
    ("entropy_base32", ALONE.format("A-Z2-7"), string.ascii_uppercase + "234567", WIDTH, 3.32),
    ("entropy_lower", ALONE.format("a-z0-9"), string.ascii_lowercase + string.digits, WIDTH, 3.37),
    ("entropy_base64", r"[A-Za-z0-9+/_-]{16,}", string.ascii_letters + string.digits + "+/_-", WIDTH, 3.5),
]
#: Every candidate lies in a match of this.
ANY_CLASS = CLASSES[-1][1]
DIGIT_FREE_BITS = 3.75

ALLOW_LIST = [
    # words, numbers, and both in paths and names: nowhere do letters and digits meet, or capitals follow small letters
    r"^(?!.*([a-z][A-Z0-9]|[A-Z]{2}[a-z]|[A-Z][0-9]|[0-9][A-Za-z]))",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUIDs
    r"(?i)example|placeholder|changeme|dummy",
]

#: Positions of matches are summed up by blocks of this many.
BLOCK = 256

SPAN = "struct<start:int,rank:int,end:int,kind:string,hit:string>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """Spans of all matches. The text between matches and the matches
    themselves alternate, so positions are running sums of their lengths, by
    blocks first and then inside each block."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    found = F.transform(F.filter(pairs, lambda p: p["hit"].isNotNull()),  # one gap more than matches
                        lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), p["hit"].alias("hit")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + F.char_length(p["hit"]))

    def starts(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(blocks, first, lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                           lambda s: s["out"])

    def spans(blocks: Column, at: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(
            b, F.struct(F.get(at, i).alias("at"), none.alias("spans")), step, lambda s: s["spans"])))

    run = bind(found, lambda f: bind(
        F.transform(F.sequence(F.lit(1), F.size(f), F.lit(BLOCK)), lambda i: F.slice(f, i, BLOCK)),
        lambda blocks: bind(starts(blocks), lambda at: spans(blocks, at))))
    return F.when(F.regexp_like(text, F.lit(pattern)), run).otherwise(none)


def weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def best_entropy(candidate: Column, symbols: str, width: int) -> Column:
    """The largest entropy of any window of ``width`` (at most 255) characters, by
    incremental counts: a byte a symbol, eight symbols a word."""
    numbers = F.split(F.lit(",".join(str(symbols.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    shift = lambda name, value, k: F.call_function(name, value, k.bitwiseAND(F.lit(7)) * 8)
    word = lambda k: F.shiftright(k, 3)

    def count(counts: Column, k: Column) -> Column:
        return shift("shiftrightunsigned", F.get(counts, word(k)), k).bitwiseAND(F.lit(255))

    def change(k: Column, j: Column) -> Column:
        return F.when(j == word(k), shift("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= width, F.get(codes, i - width)).otherwise(-1)
            counts = F.transform(state["counts"], lambda c, j: c + change(enters, j) - change(leaves, j))
            before_in, before_out = count(state["counts"], enters), count(state["counts"], leaves)
            moved = F.when(enters == leaves, 0.0).otherwise(
                weight(before_in + 1) - weight(before_in)
                + F.when(leaves >= 0, weight(before_out - 1) - weight(before_out)).otherwise(0.0))
            total = state["total"] + moved
            least = F.when(i >= width - 1, F.least(state["least"], total)).otherwise(state["least"])
            return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(symbols) // 8 + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(math.inf).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: math.log2(width) - s["least"] / width)

    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    return bind(F.transform(chars, lambda c: F.get(numbers, F.ascii(c))), slide)


def long_value(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.char_length(F.regexp_extract(s["hit"], pattern, 2)) >= ASSIGN_VALUE_CHARS


def secret(symbols: str, width: int, bits: float, allow_list: list[str]) -> Callable[[Column], Column]:
    def test(s: Column) -> Column:
        allowed = F.lit(False)
        for known in allow_list:
            allowed = allowed | F.regexp_like(s["hit"], F.lit(known))
        need = F.when(F.regexp_like(s["hit"], F.lit("[0-9]")), bits).otherwise(max(bits, DIGIT_FREE_BITS))
        return F.when(allowed, False).otherwise(best_entropy(s["hit"], symbols, width) >= need - 1e-9)
    return test


def add_apart(spans: Column, more: Column) -> Column:
    """``spans`` and those of ``more`` that overlap none of them."""
    def step(state: Column, one: Column) -> Column:
        meets = F.exists(state["found"], lambda f: (f["start"] < one["end"]) & (one["start"] < f["end"]))
        return F.struct(F.when(meets, state["found"]).otherwise(F.concat(state["found"], F.array(one))).alias("found"))
    return F.aggregate(more, F.struct(spans.alias("found")), step, lambda s: s["found"])


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, allow_list: list[str] | None = None) -> DataFrame:
    """``doc_id, base, found`` for every row: arrays of spans (start, rank, end,
    kind, hit) of the base kinds and of all kinds."""
    allow_list = ALLOW_LIST if allow_list is None else allow_list
    text = F.col("_text")
    rows = docs.select("doc_id", whole_text().alias("_text"))
    kinds = {}
    for rank, (kind, pattern) in enumerate(BASE):
        spans = matches(text, kind, rank, pattern)
        if kind == "assign":
            spans = F.filter(spans, long_value(pattern))
        kinds[f"_{kind}"] = spans
    none = F.array().cast(f"array<{SPAN}>")
    for rank, (kind, pattern, symbols, width, bits) in enumerate(CLASSES, len(BASE)):
        spans = F.filter(matches(text, kind, rank, pattern), secret(symbols, width, bits, allow_list))
        kinds[f"_{kind}"] = F.when(F.regexp_like(text, F.lit(ANY_CLASS)), spans).otherwise(none)
    rows = rows.select("doc_id", *[c.alias(k) for k, c in kinds.items()])
    rows = rows.withColumn("base", F.concat(*[f"_{k}" for k, _ in BASE]))
    found = F.col("base")
    for kind, *_ in CLASSES:
        found = add_apart(found, F.col(f"_{kind}"))
    return rows.select("doc_id", "base", found.alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k, _ in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                          listed(F.col("found")).alias("spans"))
