"""Text projections: strip / clean / fingerprint / preview."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# FIXED VALUES -- the characters Python's str.strip()/str.isspace() and the
# Unicode ``\s`` of Python ``re`` treat as whitespace: TAB, LF, VT, FF, CR,
# U+001C..U+001F, SPACE, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
# U+2029, U+202F, U+205F, U+3000. Written as a class that Java regex and RE2
# both read the same way, so Spark and the DuckDB oracle agree exactly.
# ----------------------------------------------------------------------------
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"
COLLAPSE_PATTERN = rf"{WS_CLASS}+"
CLEAN_MAX_CHARS = 500
PREVIEW_CHARS = 100


def strip(text: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace, not only blanks (``trim``)."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def clean(text: Column, max_chars: int = CLEAN_MAX_CHARS) -> Column:
    """B1: strip, turn every whitespace run (CR/LF included) into one blank,
    then cut to ``max_chars`` code points. Strip first, cut last."""
    return F.substring(F.regexp_replace(strip(text), COLLAPSE_PATTERN, " "), 1, max_chars)


def fingerprint(text: Column) -> Column:
    """B2: md5 hex of the UTF-8 text."""
    return F.md5(text)


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` code points."""
    return F.substring(text, 1, n)


def nonempty(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def first_nonempty(*cols: Column) -> Column:
    """A3: Python ``a or b or c`` over strings: skips null *and* empty."""
    return F.coalesce(*[nonempty(c) for c in cols])


# Tokens for the word-set stand-in scorer: lower-cased runs of letters,
# digits and underscore (same class in Java regex and RE2).
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), ""))
