"""Second stage and the hybrid cascade.

Shape of the cascade, per (case, config):
  rules decide SENSITIVE            -> SENSITIVE, method ``regex:<names>``, 0 ms
  otherwise the scorer's answer     -> SENSITIVE/PUBLIC, method ``llm:<label>``
  unparsable / error / no answer    -> SENSITIVE, method ``failsafe`` (B10)

Rules run once per case, before the config expansion (they do not depend on
the config). The scorer sees undecided rows only. Answers come from one of:
  * a landed ``responses`` table (case_id, config_id, raw, error, latency_ms),
    joined with one LEFT JOIN on the narrow (text-free) rows;
  * an injected batch callable run under ``mapInArrow`` (the one Python
    worker step of the engine); its answers are landed in the shared
    checkpoint folder before use, so re-evaluation never re-scores;
  * by default the deterministic stand-in (pure Column expressions).
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.functions import answers as A
from veilspark.functions import prompts as P
from veilspark.operators.classify import classify, method_of_rules
from veilspark.session import scratch_path

RESPONSE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType(), False),
    T.StructField("config_id", T.IntegerType(), False),
    T.StructField("raw", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
])

# A scorer takes a pandas frame (case_id, config_id, model, endpoint, prompt)
# and returns (raw, error, latency_ms) per row, in order.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def standin_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Default callable: the deterministic stand-in, computed in Python."""
    out = [A.standin_answer_py(int(c), t) for c, t in zip(pdf["config_id"], pdf["text"])]
    return pd.DataFrame(out, columns=["raw", "error", "latency_ms"])


class PartialAnswers(Exception):
    """Raised by a scorer that could answer some rows of a batch only: ``done`` is a
    frame (raw, error, latency_ms) indexed by the positions it has answers for."""

    def __init__(self, done: pd.DataFrame, why: str = "") -> None:
        super().__init__(why)
        self.done = done


ROWS_PER_CALL = 256


def score_rows(df: DataFrame, scorer: Scorer, keys: str, rows_per_call: int = ROWS_PER_CALL) -> DataFrame:
    """``keys`` (columns of ``df``, as a schema) with raw, error and latency_ms, by an
    injected callable under ``mapInArrow``.

    The callable gets at most ``rows_per_call`` rows at a time, and only these are
    made into Python objects: of longer Arrow batches a task holds no more than the
    batch itself (at most ``spark.sql.execution.arrow.maxBytesPerBatch``). If it raises, the
    rows it has no answer for (all of the call's, unless it raises
    ``PartialAnswers``) are tried one by one, so that only those that raise get an
    ``error`` (the cascade then fails safe), with the time their call took; the
    task never fails, and no row is asked more than twice."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(keys).fields}
    answer = ["raw", "error", "latency_ms"]

    def one(row: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        try:
            return scorer(row)[answer]
        except Exception as e:  # noqa: BLE001 - becomes a fail-safe row
            return pd.DataFrame({"raw": [None], "error": [str(e)], "latency_ms": [(time.perf_counter() - began) * 1000.0]})

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return scorer(rows)[answer].reset_index(drop=True)
        except Exception as e:  # noqa: BLE001 - found row by row
            done = e.done[answer] if isinstance(e, PartialAnswers) else pd.DataFrame(columns=answer)
            parts = [done.loc[[i]] if i in done.index else one(rows.iloc[[i]]) for i in range(len(rows))]
            return pd.concat(parts, ignore_index=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, rows_per_call):
                part = batch.slice(at, rows_per_call)
                res = call(part.to_pandas())
                yield pa.RecordBatch.from_pydict({k: part.column(k).cast(kind) for k, kind in kinds.items()} | {
                    "raw": pa.array(res["raw"].astype(object), pa.string(), from_pandas=True), "error": pa.array(res["error"].astype(object), pa.string(), from_pandas=True),
                    "latency_ms": pa.array(res["latency_ms"].astype("float64"), pa.float64(), from_pandas=True)})
    return df.mapInArrow(run, f"{keys}, raw string, error string, latency_ms double")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Python at most ``rows`` rows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score_batches(df: DataFrame, scorer: Scorer = standin_scorer, rows_per_call: int = ROWS_PER_CALL) -> DataFrame:
    """Every row of ``df`` scored, as ``RESPONSE_SCHEMA``."""
    return score_rows(df, scorer, "case_id long, config_id int", rows_per_call)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage and
    pins non-deterministic results (scorer answers) across retries."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def undecided_requests(classified: DataFrame, configs: list[dict]) -> DataFrame:
    """Rows the scorer must answer: undecided cases x configs, with the
    rendered prompt (B5) for the request."""
    cfg = ("config_id", "model", "endpoint", "system", "template", "max_tokens")
    und = classified.where(F.col("verdict") != F.lit(A.SENSITIVE)).select("case_id", "text")
    return (P.with_configs(und, configs, cfg)
            .withColumn("prompt", P.render_prompt(F.col("template"), F.col("text"))))


def cascade(cases: DataFrame, configs: list[dict], rule_set: str = "v4",
            responses: DataFrame | None = None, scorer: Scorer | None = None,
            strip_think: bool = True, keep_text: bool = False, store: str | None = None) -> DataFrame:
    """D8 over cases x configs. ``cases`` needs case_id, text, label. With a
    ``store``, the scorer is asked for requests without a kept answer only."""
    classified = classify(cases, rule_set)
    passthrough = [c for c in cases.columns if c not in ("text",)] + (["text"] if keep_text else [])
    if scorer is not None and responses is None:
        requests = undecided_requests(classified, configs)
        if store is not None:
            from veilspark.operators.answer_store import ask
            responses = ask(requests, store, scorer)
        else:
            with batches_of(requests.sparkSession, ROWS_PER_CALL):
                responses = land(score_batches(requests, scorer), "responses")
    if responses is not None:
        rows = P.with_configs(classified.select(*passthrough, "matches", "verdict"), configs, ("config_id",))
        rows = rows.join(responses.select("case_id", "config_id", "raw", "error", "latency_ms"),
                         ["case_id", "config_id"], "left")
        raw, err, lat = F.col("raw"), F.col("error"), F.col("latency_ms")
    else:
        rows = P.with_configs(classified.select(*(passthrough + ([] if keep_text else ["text"])),
                                                "matches", "verdict"), configs, ("config_id",))
        raw, err, lat = A.standin_answer(F.col("config_id"), F.col("text"))
        rows = rows.withColumn("raw", F.when(F.col("verdict") != A.SENSITIVE, raw)) \
                   .withColumn("error", F.when(F.col("verdict") != A.SENSITIVE, err)) \
                   .withColumn("latency_ms", F.when(F.col("verdict") != A.SENSITIVE, lat))
        raw, err, lat = F.col("raw"), F.col("error"), F.col("latency_ms")
    decided = F.col("verdict") == F.lit(A.SENSITIVE)
    answered = F.col("raw").isNotNull() | F.col("error").isNotNull()
    parsed = F.when(~decided & answered, A.parse_answer(raw, err, strip_think))
    out = rows.withColumn("parsed", parsed)
    ok = F.col("parsed").isin(A.SENSITIVE, A.PUBLIC)
    out = out.select(
        *[c for c in rows.columns if c not in ("raw", "error", "latency_ms", "text")],
        *(["text"] if keep_text else []),
        "raw", "error", "parsed",
        F.when(decided, F.lit(A.SENSITIVE)).when(ok, F.col("parsed")).otherwise(F.lit(A.SENSITIVE)).alias("predicted"),
        F.when(decided, method_of_rules(F.col("matches")))
         .when(ok, F.concat(F.lit("llm:"), F.lower(F.col("parsed"))))
         .otherwise(F.lit("failsafe")).alias("method"),
        F.when(decided, F.lit(0.0)).otherwise(F.coalesce(lat, F.lit(0.0))).alias("latency_ms"),
    )
    return out


def second_stage_only(cases: DataFrame, configs: list[dict], strip_think: bool = True) -> DataFrame:
    """Every case goes to the scorer (no rules); fail-safe still applies."""
    rows = P.with_configs(cases.select("case_id", "label", "text"), configs, ("config_id",))
    raw, err, lat = A.standin_answer(F.col("config_id"), F.col("text"))
    parsed = A.parse_answer(raw, err, strip_think)
    return rows.select("case_id", "config_id", "label", parsed.alias("parsed"), lat.alias("latency_ms")) \
        .withColumn("predicted", A.failsafe(F.col("parsed"))) \
        .withColumn("method", F.when(F.col("parsed").isin(A.SENSITIVE, A.PUBLIC),
                                     F.concat(F.lit("llm:"), F.lower("parsed"))).otherwise(F.lit("failsafe")))


def route(pred: DataFrame) -> DataFrame:
    """SENSITIVE -> local, PUBLIC -> cloud."""
    return pred.withColumn("route", F.when(F.col("predicted") == A.PUBLIC, F.lit("cloud")).otherwise(F.lit("local")))
