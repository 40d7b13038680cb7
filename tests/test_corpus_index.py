import pytest

from veilspark.operators import corpus as CO
from veilspark.operators import corpus_index as CI
from veilspark.sources import commits
from veilspark.sources.registry import SOURCES

from .conftest import SF

SCHEMA = "case_id long, local_id long, local_turn long, text string, label string, source string, source_rank int, lang string, bucket_order int"


def candidates(spark, rows):
    """(source rank, id, text)"""
    full = [(i, i, 0, t, f"L{r}", f"s{r}", r, None, 0) for r, i, t in rows]
    return CO.candidates(spark.createDataFrame(full, SCHEMA).repartition(3))


def texts(index, spark):
    return sorted((r["source_rank"], r["case_id"], r["text"]) for r in index.corpus(spark).collect())


def plain(rows):
    first = {}
    for r, i, t in sorted(rows):
        if t is not None and len(t.strip()) >= 10:
            first.setdefault(t.strip(), (r, i, t.strip()))
    return sorted(first.values())


def test_batches_equal_all_at_once(spark, tmp_path):
    one = [(1 + i % 2, i, f" message number {i % 40} ") for i in range(120)] + [(1, 900, None), (1, 901, "short"), (2, 902, "")]
    two = [(3, 1000 + i, f"message number {i % 70}") for i in range(200)] + [(4, 2000 + i, "the same hot message") for i in range(500)]
    three = [(5, 3000 + i, f"message number {i}") for i in range(90)] + [(5, 4000, "the same hot message")]
    index = CI.CorpusIndex(str(tmp_path / "c"), buckets=4, blocks=2)
    for name, rows in (("1", one), ("2", two), ("3", three)):
        assert CI.add(candidates(spark, rows), index, name)
    assert texts(index, spark) == plain(one + two + three)
    assert not CI.add(candidates(spark, two), index, "2")
    with pytest.raises(commits.OtherContent):
        CI.add(candidates(spark, three), index, "2")
    assert texts(index, spark) == plain(one + two + three)
    assert index.seen(spark).count() == len(plain(one + two + three))


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    index = CI.CorpusIndex(str(tmp_path / "c"), buckets=4)
    rows = [(1, i, f"message number {i}") for i in range(50)]

    def dies(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", dies)
        with pytest.raises(RuntimeError):
            CI.add(candidates(spark, rows), index, "1")
    assert texts(index, spark) == [] and index.seen(spark).count() == 0
    assert CI.add(candidates(spark, rows), index, "1") and texts(index, spark) == plain(rows)
    spark.sql(f"DROP TABLE {index.table}")  # another session names the folder anew
    assert index.seen(spark).count() == 50


def test_index_is_not_shuffled(spark, tmp_path):
    index = CI.CorpusIndex(str(tmp_path / "c"), buckets=6)
    CI.add(candidates(spark, [(1, i, f"message number {i}") for i in range(500)]), index, "1")
    new = candidates(spark, [(2, i, f"message number {i}") for i in range(450, 600)])
    told = CI.split_by_bloom(new, index)
    assert told.where("NOT _maybe").count() >= 95 and told.where("_maybe").count() >= 50
    plan = CI.unseen(told, index)._jdf.queryExecution().executedPlan().toString()
    left, right = plan.split("SortMergeJoin")[1].split("corpus_index_")[0], plan[plan.rindex("+- ", 0, plan.rindex("corpus_index_")):]
    assert "SelectedBucketsCount: 6 out of 6" in plan or "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(fp") == 1 and "Exchange" not in right and left


def test_sources_in_two_batches(spark, tmp_path):
    index = CI.CorpusIndex(str(tmp_path / "c"), buckets=4)
    CI.add(CO.candidates(CO.union_sources(spark, SF, SOURCES[:4])), index, "1")
    CI.add(CO.candidates(CO.union_sources(spark, SF, SOURCES[4:], 5)), index, "2")
    names = ["case_id", "text", "label", "source", "lang", "fp"]
    assert sorted(map(tuple, index.corpus(spark).select(*names).collect()), key=str) == sorted(map(tuple, CO.build_corpus(spark, SF).select(*names).collect()), key=str)
