"""Scorer answers kept by content (D6, M4): equal requests are asked once.

A request is known by the MD5 of its whole body (model, system and user message,
decode options), not by the case it came from. The different requests of a run
are found by an aggregation (a text held by a third of all cases is one row
before the shuffle), those the store has an answer for are taken out, the rest
are scored, and their answers are committed to the store as one batch. Every
request is then joined with its answer.

A run that is repeated under its id asks nothing again, and neither does a later
run over the same requests. An error of the scorer is kept as an answer unless
``retry_errors`` asks such requests again in later runs; an answer without an
error then wins over one with. Only a task that Spark runs again after a loss
asks its requests twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import prompts as P
from veilspark.operators import cascade as K
from veilspark.sources import commits

KEY = "request_md5"
ANSWERS = f"{KEY} string, raw string, error string, latency_ms double, run string"


def request_key() -> F.Column:
    """MD5 of the request's body; needs model, system, prompt and max_tokens."""
    return F.md5(P.build_request(F.col("model"), F.col("system"), F.col("prompt"), F.col("max_tokens")))


def answers(spark: SparkSession, store: str) -> DataFrame:
    """One row for each request the store has an answer for: one without an error
    if there is one, of the first run by name."""
    rows = commits.committed(spark, store, ANSWERS)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "run", "raw", "error", "latency_ms")).alias("a")
    return rows.groupBy(KEY).agg(best).select(KEY, "a.raw", "a.error", "a.latency_ms", "a.run")


def open_requests(requests: DataFrame, store: str, retry_errors: bool = False) -> DataFrame:
    """The different requests without an answer, one row each."""
    told = [c for c in requests.columns if c not in ("case_id", "config_id")]
    keyed = requests.withColumn(KEY, request_key())
    one = F.min(F.struct("config_id", "case_id", *told)).alias("r")
    known = answers(requests.sparkSession, store)
    if retry_errors:
        known = known.where("error IS NULL")
    return keyed.groupBy(KEY).agg(one).join(known.select(KEY), KEY, "left_anti").select(KEY, "r.*")


def ask(requests: DataFrame, store: str, scorer: K.Scorer = K.standin_scorer, run: str | None = None,
        rows_per_call: int = K.ROWS_PER_CALL, retry_errors: bool = False) -> DataFrame:
    """``case_id, config_id, raw, error, latency_ms, run`` for every request of
    ``requests`` (as ``cascade.undecided_requests`` gives them); ``run`` is the
    run that asked."""
    spark, run = requests.sparkSession, run or f"run-{uuid.uuid4().hex[:12]}"
    if run not in commits.markers(spark, store):
        scored = K.score_rows(open_requests(requests, store, retry_errors), scorer, f"{KEY} string", rows_per_call)
        with K.batches_of(spark, rows_per_call):
            commits.commit(scored.select(KEY, "raw", "error", "latency_ms", F.lit(run).alias("run")), store, run)
    keyed = requests.select("case_id", "config_id", request_key().alias(KEY))
    return keyed.join(answers(spark, store), KEY, "left").select("case_id", "config_id", "raw", "error", "latency_ms", "run")
