"""Scorer answers: parse paths, fail-safe, method labels, missing rows."""

from pyspark.sql import functions as F

from veilspark.functions import answers as A
from veilspark.operators import cascade as K


def test_parse_paths(spark):
    rows = [("SENSITIVE", None, "SENSITIVE"), ("public", None, "PUBLIC"),
            ("Not sensitive, public", None, "SENSITIVE"), ("", None, "UNCERTAIN"),
            (None, None, "UNCERTAIN"), (None, "timeout", "ERROR:timeout"),
            ("<think>looks sensitive</think> PUBLIC", None, "PUBLIC"),
            ("<think>multi\nline sensitive</think>public", None, "PUBLIC"),
            ("<think>could be sensitive", None, "SENSITIVE")]
    df = spark.createDataFrame(rows, "raw string, error string, want string")
    got = df.select(A.parse_answer(F.col("raw"), F.col("error")).alias("p"), "want").collect()
    assert all(r["p"] == r["want"] for r in got), got
    # without the thinking strip (v6/v7) a closed block still counts
    r = spark.createDataFrame([("<think>sensitive?</think> PUBLIC",)], "raw string")
    assert r.select(A.parse_answer(F.col("raw"), None, False).alias("p")).first()["p"] == "SENSITIVE"


def test_failsafe_and_missing_rows(spark):
    cases = spark.createDataFrame(
        [(1, "a@b.co", "SENSITIVE"), (2, "hello", "PUBLIC"), (3, "world", "SENSITIVE"), (4, "again", "PUBLIC")],
        "case_id long, text string, label string")
    configs = [{"config_id": 1, "model": "m", "endpoint": "generate", "prompt_name": "p"}]
    responses = spark.createDataFrame(
        [(2, 1, "PUBLIC", None, 200.0), (3, 1, None, "boom", 150.0)],
        "case_id long, config_id int, raw string, error string, latency_ms double")
    out = {r["case_id"]: r for r in K.cascade(cases, configs, "v4", responses=responses).collect()}
    assert (out[1]["predicted"], out[1]["method"], out[1]["latency_ms"]) == ("SENSITIVE", "regex:email", 0.0)
    assert (out[2]["predicted"], out[2]["method"]) == ("PUBLIC", "llm:public")
    assert (out[3]["predicted"], out[3]["method"], out[3]["latency_ms"]) == ("SENSITIVE", "failsafe", 150.0)
    assert (out[4]["predicted"], out[4]["method"], out[4]["latency_ms"]) == ("SENSITIVE", "failsafe", 0.0)


def test_python_scorer_hook_matches_column_standin(spark):
    cases = spark.createDataFrame([(i, f"message number {i}", "PUBLIC") for i in range(40)],
                                  "case_id long, text string, label string")
    configs = [{"config_id": c, "model": "m", "endpoint": "generate", "prompt_name": "p",
                "system": "s", "template": "{text}", "max_tokens": 10} for c in (1, 2)]
    a = K.cascade(cases, configs, "v4").select("case_id", "config_id", "predicted", "method", "latency_ms")
    b = K.cascade(cases, configs, "v4", scorer=K.standin_scorer).select(
        "case_id", "config_id", "predicted", "method", "latency_ms")
    assert sorted(a.collect()) == sorted(b.collect())


def test_scorer_exception_fails_safe(spark):
    cases = spark.createDataFrame([(1, "hi", "PUBLIC")], "case_id long, text string, label string")
    configs = [{"config_id": 1, "model": "m", "endpoint": "generate", "prompt_name": "p",
                "system": "s", "template": "{text}", "max_tokens": 10}]

    def broken(pdf):
        raise RuntimeError("server down")
    r = K.cascade(cases, configs, "v4", scorer=broken).first()
    assert (r["predicted"], r["method"]) == ("SENSITIVE", "failsafe")
