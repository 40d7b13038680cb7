"""Small surfaces: source registry on a missing path (A4), model family (B12),
label normalisation (B14), seeded demos (K5), prompt rendering (B5/B6)."""

from pyspark.sql import functions as F

from veilspark.functions import answers as A
from veilspark.functions import prompts as P
from veilspark.sources.registry import SourceSpec, spec_rows
from tests.conftest import SF


def test_missing_source_is_empty_not_error(spark):
    spec = SourceSpec("nowhere", "no_such_table", "PUBLIC", 1, 10)
    assert spec_rows(spark, SF, spec) is None


def test_model_family_and_endpoint(spark):
    df = spark.createDataFrame([("llama3.2:3b | G: x",), ("qwen3:4b | G",)], "name string")
    got = df.select(P.model_family(F.col("name")).alias("m")).withColumn("e", P.endpoint_column(F.col("m"))).collect()
    assert [(r["m"], r["e"]) for r in got] == [("llama3.2:3b", "generate"), ("qwen3:4b", "chat")]


def test_normalise_label(spark):
    df = spark.createDataFrame([(" sensitive ",), ("Public.",), ("maybe",), (None,)], "x string")
    got = [r["y"] for r in df.select(A.normalise_label(F.col("x")).alias("y")).collect()]
    assert got == ["SENSITIVE", "PUBLIC", "SENSITIVE", "SENSITIVE"]


def test_seed_demos_balanced():
    labels = [l for _, l in P.SEED_DEMOS_BALANCED]
    assert labels.count("SENSITIVE") == 5 and labels.count("PUBLIC") == 5


def test_render_prompt_is_literal(spark):
    text = "a {b} $1 \\ c"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(P.render_prompt(F.lit('Message: "{text}"'), F.col("t")).alias("p")).first()["p"]
    assert r == 'Message: "' + text + '"'
    ex = P.examples_literal([("x" * 200, "PUBLIC")])
    f = df.select(P.render_fewshot_prompt(ex, F.lit("hi")).alias("p")).first()["p"]
    assert f == "Examples:\n" + 'Message: "' + "x" * 150 + '" -> PUBLIC' + "\n\n" + 'Message: "hi"' + "\nClassification:"
