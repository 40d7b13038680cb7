"""Scorer answers: thinking-block strip, parse, fail-safe, method, outcome
(B4, B8-B11, B14) and the deterministic stand-in answer table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVE, PUBLIC, UNCERTAIN = "SENSITIVE", "PUBLIC", "UNCERTAIN"
THINK_PATTERN = r"(?s)<think>.*?</think>"


def strip_thinking(raw: Column) -> Column:
    """Drop closed thinking blocks (non-greedy, dot matches newline). An
    unclosed block is left in place."""
    return F.regexp_replace(raw, THINK_PATTERN, "")


def parse_answer(raw: Column, error: Column | None = None, strip_think: bool = True) -> Column:
    """SENSITIVE if the upper-cased answer contains it, else PUBLIC if it
    contains that, else UNCERTAIN; an error becomes ``ERROR:<msg>``."""
    body = F.upper(strip_thinking(raw) if strip_think else raw)
    parsed = (F.when(F.contains(body, F.lit(SENSITIVE)), F.lit(SENSITIVE))
               .when(F.contains(body, F.lit(PUBLIC)), F.lit(PUBLIC))
               .otherwise(F.lit(UNCERTAIN)))
    if error is None:
        return parsed
    return F.when(error.isNotNull(), F.concat(F.lit("ERROR:"), error)).otherwise(parsed)


def normalise_label(x: Column) -> Column:
    """Strip + upper, then the same containment test, fail-safe."""
    u = F.upper(F.trim(x))
    return (F.when(F.contains(u, F.lit(SENSITIVE)), F.lit(SENSITIVE))
             .when(F.contains(u, F.lit(PUBLIC)), F.lit(PUBLIC))
             .otherwise(F.lit(SENSITIVE)))


def failsafe(parsed: Column) -> Column:
    """Anything but SENSITIVE/PUBLIC (UNCERTAIN, ERROR, missing) -> SENSITIVE."""
    return F.when(parsed.isin(SENSITIVE, PUBLIC), parsed).otherwise(F.lit(SENSITIVE))


def outcome(label: Column, predicted: Column, definition: str = "v1") -> Column:
    """OK / LEAK / FP (v1+); v0 tags OK / LEAK (any SENSITIVE miss) / MISS."""
    if definition == "v0":
        return (F.when(predicted == label, F.lit("OK"))
                 .when(label == F.lit(SENSITIVE), F.lit("LEAK"))
                 .otherwise(F.lit("MISS")))
    return (F.when(predicted == label, F.lit("OK"))
             .when((label == F.lit(SENSITIVE)) & (predicted == F.lit(PUBLIC)), F.lit("LEAK"))
             .otherwise(F.lit("FP")))


def _hexint(h: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(h, start, n), 16, 10).cast("int")


# ----------------------------------------------------------------------------
# Deterministic stand-in answers. No model ships with this engine: queries on
# the driver tables use answers derived from md5(config_id | text), shaped to
# exercise every parse path (plain, lower case, both words, closed and
# unclosed thinking block, unparsable, error). Mechanical only -- these rates
# say nothing about privacy quality. The DuckDB oracle repeats the formula.
# ----------------------------------------------------------------------------
STANDIN_ANSWERS = [
    # (bucket upper bound on k = md5-byte % 20, raw answer)
    (8, "SENSITIVE"),
    (15, "PUBLIC"),
    (16, "public"),
    (17, "Not sensitive, public"),
    (18, "<think>looks sensitive</think> PUBLIC"),
    (19, "<think>could be sensitive"),
    (20, "I cannot tell"),
]
STANDIN_ERROR = "timeout"


def standin_hash(config_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", config_id.cast("string"), F.coalesce(text, F.lit(""))))


def standin_answer(config_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """(raw, error, latency_ms) for one (config, message)."""
    h = standin_hash(config_id, text)
    k = _hexint(h, 1, 2) % 20
    is_err = (_hexint(h, 3, 2) % 25) == 0
    raw = None
    for bound, answer in STANDIN_ANSWERS:
        raw = (F.when(k < bound, F.lit(answer)) if raw is None else raw.when(k < bound, F.lit(answer)))
    raw = F.when(is_err, F.lit(None).cast("string")).otherwise(raw)
    error = F.when(is_err, F.lit(STANDIN_ERROR))
    latency = (F.lit(120) + _hexint(h, 5, 3) % 400).cast("double")
    return raw, error, latency


def standin_answer_py(config_id: int, text: str | None) -> tuple[str | None, str | None, float]:
    """The same stand-in in plain Python, used as the default batch scorer
    callable under ``mapInArrow``."""
    import hashlib
    h = hashlib.md5(f"{config_id}|{text or ''}".encode()).hexdigest()
    k = int(h[0:2], 16) % 20
    latency = float(120 + int(h[4:7], 16) % 400)
    if int(h[2:4], 16) % 25 == 0:
        return None, STANDIN_ERROR, latency
    for bound, answer in STANDIN_ANSWERS:
        if k < bound:
            return answer, None, latency
    return None, None, latency
