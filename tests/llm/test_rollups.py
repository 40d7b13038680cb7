from collections import Counter

import pyarrow as pa
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

from veilspark.llm import rollups, tokens
from veilspark.session import scratch_path

SCHEMA = "doc_id long, text string, source string, lang string, tokenizer string"
ROWS = [(1, "one two", "a", "en", "x"), (2, "one two", "a", "en", "x"), (3, None, None, None, "x"), (4, "", "b", "en", "x"),
        (5, "drei vier fünf " * 3000, "b", "de", "x"), (1, "one two", "a", "en", "x")]


def counts(spark, rows=ROWS):
    return rollups.count_tokens(spark.createDataFrame(rows, SCHEMA), ["word_bpe_49k", "byte_bpe_50k"])


def seen(spark, store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollups.totals(spark, store).collect()}


def brute(rows, models):
    docs, total = Counter(), Counter()
    for _, text, source, lang, _ in rows:
        for name, model in models.items():
            docs[source, lang, name] += 1
            total[source, lang, name] += int(model.count(pa.array([text], pa.string()))[0])
    return {k: (docs[k], total[k]) for k in docs}


def test_deltas_keep_totals_equal_to_a_recount(spark):
    store, models = scratch_path(spark, "rollups"), {n: tokens.load(n) for n in tokens.TOKENIZERS}
    rollups.commit(rollups.inserts(counts(spark)), store, "1")
    assert seen(spark, store) == brute(ROWS, models)
    rollups.commit(rollups.deletes(counts(spark, ROWS[:1])), store, "2")
    rollups.commit(rollups.deletes(counts(spark, ROWS[:1])), store, "2")  # repeated: counts once
    assert seen(spark, store) == brute(ROWS[1:], models)
    moved = counts(spark, ROWS[4:5]).withColumn("lang", F.lit("de"))
    rollups.commit(rollups.revisions(moved, F.col("n_tokens") * 0), store, "3")
    got = seen(spark, store)
    assert got["b", "de", "word_bpe_49k"] == (1, 0) and got["a", "en", "word_bpe_49k"][0] == 2
    rollups.commit(rollups.deletes(counts(spark, ROWS[2:3])), store, "4")
    assert (None, None, "word_bpe_49k") not in seen(spark, store)


def test_revision_moves_between_keys(spark):
    store = scratch_path(spark, "rollups")
    change = spark.createDataFrame([("insert", "a", "en", "t", 5, None, None, None, 0), ("revise", "b", "de", "t", 7, "a", "en", 5, 0)],
                                   rollups.CHANGES + ", n_docs int")
    rollups.commit(change, store, "1")
    assert seen(spark, store) == {("b", "de", "t"): (1, 7)}


def test_empty(spark):
    store = scratch_path(spark, "rollups")
    rollups.commit(rollups.inserts(counts(spark, [])), store, "1")
    assert seen(spark, store) == {}


def test_a_crash_between_and_other_content(spark, monkeypatch):
    store, models = scratch_path(spark, "rollups"), {n: tokens.load(n) for n in tokens.TOKENIZERS}
    rollups.commit(rollups.inserts(counts(spark)), store, "1")

    def dies(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(rollups.commits, "publish", dies)
        with pytest.raises(RuntimeError):
            rollups.commit(rollups.deletes(counts(spark, ROWS[:1])), store, "2")
    assert seen(spark, store) == brute(ROWS, models)  # the batch that died is not seen, the first one still is
    assert rollups.commit(rollups.deletes(counts(spark, ROWS[:1])), store, "2")
    assert not rollups.commit(rollups.deletes(counts(spark, ROWS[:1])), store, "2")
    with pytest.raises(rollups.commits.OtherContent):
        rollups.commit(rollups.inserts(counts(spark, ROWS[:2])), store, "2")
    assert seen(spark, store) == brute(ROWS[1:], models)
