"""The pipeline on a planted corpus, stage by stage, against what each stage's
operator must do to its own input."""

import random

import corpus_pipeline
from veilspark.llm import line_dedup
from veilspark.session import scratch_path

from .test_near_dedup import brute, edited, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(8)
LINE = "This boiler plate line stands in many documents."


def corpus():
    rows = [prose(120) + ".\n" + prose(80) + "." for _ in range(400)]
    rows = ["BUY!! NOW!! " * 60 if i % 7 == 3 else t for i, t in enumerate(rows)]
    rows[12] = rows[13].replace(rows[13].split()[50], "other")
    rows[20] = rows[22]
    for i in (40, 41, 43, 44, 46):
        rows[i] += "\n" + LINE
    bench = [prose(30) for _ in range(3)]
    rows[50] += " " + bench[0]
    rows[51] = rows[51].replace(".\n", " " + edited(bench[1], 2) + "\n")
    rows[54], rows[55] = None, ""
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], bench


def test_stages_take_effect(spark):
    rows, bench = corpus()
    folder = scratch_path(spark, "corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 3)) for i in range(400)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.land(stage(spark, docs, folder), f"test-{name}")
        assert set(docs.columns) == set(SCHEMA.replace(",", "").split()[::2])
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    text = {r[0]: r[1] for r in rows}
    after = kept["quality_classifier"]
    assert not [i for i in after if i % 7 == 3] and len([i for i in text if i % 7 != 3 and i not in after]) <= 2  # the null and the empty text
    assert kept["line_dedup"].keys() == after.keys() and sum(LINE in (t or "") for t in kept["line_dedup"].values()) == 1
    assert kept["line_dedup"][40] == text[40].removesuffix("\n" + LINE)
    assert set(kept["near_dedup"]) == set(brute(list(kept["line_dedup"].items())).values())
    assert 13 not in kept["near_dedup"] and 22 not in kept["near_dedup"]
    assert set(kept["near_dedup"]) - set(kept["benchmark_decontamination"]) == {50, 51}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(kept["benchmark_decontamination"])


def test_line_limits_are_the_contract():
    assert (line_dedup.MIN_CHARS, line_dedup.MIN_DOCS) == (20, 3)
