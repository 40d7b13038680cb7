import gc
import os

import pandas as pd
import pyarrow as pa
import pytest

from veilspark.functions import prompts as P
from veilspark.operators import answer_store as AS
from veilspark.operators import cascade as K
from veilspark.operators.classify import classify
from veilspark.sources import commits

CONFIGS = P.default_configs()[:2]


def counting(folder, fail=()):
    """A scorer that leaves one line for each row it is asked for."""
    def scorer(rows: pd.DataFrame) -> pd.DataFrame:
        with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as f:
            f.writelines(f"{c}|{t}\n" for c, t in zip(rows["config_id"], rows["text"]))
        if set(rows["text"]) & set(fail):
            raise RuntimeError("no answer")
        return K.standin_scorer(rows)
    return scorer


def calls(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)))


def cases(spark, n=60):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 10}" if i % 3 == 1 else None if i % 30 == 2 else f"own {i}", "PUBLIC") for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, text string, label string").repartition(5)


def requests(spark, configs=CONFIGS, n=60):
    return K.undecided_requests(classify(cases(spark, n)), configs)


def plain(df):
    return sorted(((r["case_id"], r["config_id"], r["raw"], r["error"], r["latency_ms"]) for r in df.collect()), key=str)


def test_every_different_request_is_asked_once(spark, tmp_path):
    asked, store = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(asked)
    rows = requests(spark)
    first = plain(AS.ask(rows, store, counting(asked)))
    once = calls(asked)
    assert len(once) == len(set(once)) == rows.select("config_id", "text").distinct().count()
    assert first == plain(K.score_batches(rows))
    assert plain(AS.ask(rows, store, counting(asked))) == first and calls(asked) == once
    more = requests(spark, P.default_configs()[:3], 70)
    assert plain(AS.ask(more, store, counting(asked))) == plain(K.score_batches(more))
    assert len(calls(asked)) == len(set(calls(asked))) == more.select("config_id", "text").distinct().count()


def test_repeated_run_and_errors(spark, tmp_path):
    asked, store = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(asked)
    rows = requests(spark)
    got = {r["text"]: r["error"] for r in rows.join(AS.ask(rows, store, counting(asked, ["hot text"]), run="a", rows_per_call=1), ["case_id", "config_id"]).collect()}
    assert got["hot text"] == "no answer" and got["text 1"] != "no answer"
    n = len(calls(asked))
    AS.ask(rows, store, counting(asked), run="a").count()
    AS.ask(rows, store, counting(asked), run="b").count()
    assert len(calls(asked)) == n
    again = AS.ask(rows, store, counting(asked), run="c", retry_errors=True)
    assert plain(again) == plain(K.score_batches(rows)) and len(calls(asked)) > n
    kept = AS.answers(spark, store)
    assert kept.count() == kept.select(AS.KEY).distinct().count()


def test_cascade_with_store_and_empty(spark, tmp_path):
    store = str(tmp_path / "store")
    want = plain(K.cascade(cases(spark), CONFIGS, scorer=K.standin_scorer).withColumnRenamed("predicted", "p").select("case_id", "config_id", "raw", "error", "latency_ms"))
    for _ in range(2):
        assert plain(K.cascade(cases(spark), CONFIGS, scorer=K.standin_scorer, store=store)) == want
    assert AS.ask(requests(spark, n=0), str(tmp_path / "empty")).count() == 0


def test_a_failing_batch_keeps_what_it_had(spark, tmp_path):
    def scorer(rows):
        with open(tmp_path / f"seen-{os.getpid()}", "a") as f:
            f.writelines(f"{c}\n" for c in rows["case_id"])
        if len(rows) > 1:
            raise K.PartialAnswers(K.standin_scorer(rows).iloc[:-1])
        return K.standin_scorer(rows)
    df = spark.createDataFrame([(i, 1, f"t{i}") for i in range(20)], "case_id long, config_id int, text string").coalesce(1)
    assert plain(K.score_batches(df, scorer, 10)) == plain(K.score_batches(df))
    seen = [line for f in tmp_path.glob("seen-*") for line in open(f)]
    assert len(seen) == 22  # two calls of ten, and the last row of each again


def test_commits(spark, tmp_path):
    store, schema = str(tmp_path / "s"), "a int"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], schema)
    read = lambda: sorted(r["a"] for r in commits.committed(spark, store, schema).collect())
    assert read() == []
    assert commits.commit(rows(1, 2), store, "b1") and commits.commit(rows(3), store, "b2")
    assert not commits.commit(rows(2, 1).repartition(3), store, "b1")  # the same rows again
    with pytest.raises(commits.OtherContent):
        commits.commit(rows(9), store, "b1")
    rows(7).write.parquet(f"{store}/data/{commits.new_attempt()}")  # died before its marker
    assert read() == [1, 2, 3]
    _, attempt = commits.markers(spark, store)["b1"]
    commits.publish(spark, store, "b1", "2_0", "0" * 32 if attempt > "0" * 32 else "f" * 32)
    assert len(commits.markers(spark, store)) == 2
    with pytest.raises(ValueError):
        commits.commit(rows(1), store, "a=b")


def test_a_call_holds_its_own_rows_only(spark, tmp_path):
    """Of a long Arrow batch, only the rows of one call are Python objects; landed answers come in short batches."""
    def scorer(rows):
        alive = sum(len(o) for o in gc.get_objects() if isinstance(o, pd.DataFrame) and "text" in o.columns)
        return pd.DataFrame({"raw": [str(alive)] * len(rows), "error": [None] * len(rows), "latency_ms": [0.0] * len(rows)})
    df = spark.createDataFrame([(2**60 + i if i % 9 else None, 1, f"t{i}") for i in range(500)], "case_id long, config_id int, text string").coalesce(1)
    got = K.score_batches(df, scorer, 20).collect()
    assert max(int(r["raw"]) for r in got) <= 40
    assert sorted(r["case_id"] or 0 for r in got) == sorted(r["case_id"] or 0 for r in df.collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with K.batches_of(spark, 7):
        sizes = df.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
    assert max(r["n"] for r in sizes) == 7 and sum(r["n"] for r in sizes) == 500 and spark.conf.get(key) == before
