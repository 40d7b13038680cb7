"""Ids, streaming over folders, replays, scorer failures, scratch folder."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark import session
from veilspark.operators import cascade as K
from veilspark.operators import corpus as CO
from veilspark.plans import catalog
from veilspark.sources.registry import SourceSpec
from veilspark.streaming import stream as ST


def test_long_conversations_and_large_ids_keep_their_rows(spark, tmp_path):
    rows = [(c, t, "user", f"message number {t} of conversation {c}") for c, t in
            ((1, 1000), (1, 1001), (2, 0), (2, 1), (10**12 + 5, 0), (10**12 + 5, 1))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spec = SourceSpec("talk", "conversations", "PUBLIC", 5, 500, id_sql="conv_id", turn_sql="turn", human_role="user", quota=100)
    got = CO.build_corpus(spark, str(tmp_path), [spec, spec]).collect()
    assert sorted(r["text"] for r in got) == sorted(r[3] for r in rows)
    assert len({r["case_id"] for r in got}) == len(rows)


@pytest.fixture()
def folders(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{src}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_streams_read_folders_of_part_files(spark, folders):
    got = catalog.QUERIES["stream_classify"](spark, folders)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.QUERIES["stream_classify"](spark, "/root/testdata/sf0.001").collect()))
    counts = ST.stream_window_counts(spark, folders)
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folders}/events.parquet").count()


def test_replayed_batch_adds_no_rows(spark, tmp_path):
    batch = spark.createDataFrame([(1, "PUBLIC", "llm:public", "cloud"), (2, "SENSITIVE", "failsafe", "local")], ST.ROUTED)
    for _ in range(2):
        ST.write_batch(batch, 0, str(tmp_path / "out"))
    ST.write_batch(batch.where("case_id = 1"), 1, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_one_raising_row_fails_alone_with_its_time(spark):
    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        import time
        if (pdf["text"] == "bad").any():
            time.sleep(0.01)
            raise ValueError("no answer")
        return pd.DataFrame({"raw": ["PUBLIC"] * len(pdf), "error": [None] * len(pdf), "latency_ms": [1.0] * len(pdf)})

    rows = spark.createDataFrame([(i, 1, "bad" if i == 3 else "fine") for i in range(8)], "case_id long, config_id int, text string").coalesce(1)
    got = {r["case_id"]: r for r in K.score_batches(rows, scorer).collect()}
    assert [i for i, r in got.items() if r["error"]] == [3] and got[3]["latency_ms"] >= 5


def test_scratch_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())


def test_landed_tables_can_be_removed(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.clean_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_every_rule_of_every_set_hits_on_probe_text(spark):
    from veilspark.functions import rules as R
    for name, rs in R.RULE_SETS.items():
        got = {r["rule"] for r in catalog.QUERIES[f"rule_hit_counts_{name}"](spark, "/root/testdata/sf0.01").collect()}
        assert {n for tier in rs.tiers for n, _ in tier} <= got, name


def test_source_read_elsewhere_or_nowhere(spark, tmp_path):
    from veilspark.sources.registry import source_status, spec_rows
    spark.createDataFrame([(1, "a text of some length"), (2, "another one")], "doc_id long, text string").write.parquet(f"{tmp_path}/new.parquet")
    first = SourceSpec("first", "old", "PUBLIC", 5, 500, other_tables=("older", "new"))
    none = SourceSpec("none", "old", "PUBLIC", 5, 500, other_tables=("older",))
    got = {r["source"]: tuple(r)[1:] for r in source_status(spark, str(tmp_path), [first, none]).collect()}
    assert got == {"first": ("new", "fallback", 2), "none": (None, "missing", 0)}
    assert spec_rows(spark, str(tmp_path), none) is None
    assert CO.build_corpus(spark, str(tmp_path), [none, first]).count() == 2


def test_alternative_source_has_its_own_rules(spark, tmp_path):
    rows = [(1, "short one"), (2, "a text of some length"), (3, "x" * 700), (4, "y" * 40), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/new.parquet")
    own = SourceSpec("other", "new", "SENSITIVE", 5, None, cut=30, quota=3)
    first = SourceSpec("first", "old", "PUBLIC", 10, 50, other_tables=("older", own, "new"))
    same = SourceSpec("same", "old", "PUBLIC", 10, 50, other_tables=("new",))
    got = [tuple(r) for r in CO.union_sources(spark, str(tmp_path), [first, same]).select("source", "label", "local_id", "text").collect()]
    assert sorted(got) == [("first", "PUBLIC", 1, "short one"), ("first", "PUBLIC", 2, "a text of some length"), ("first", "PUBLIC", 3, "x" * 30),
                           ("same", "PUBLIC", 2, "a text of some length"), ("same", "PUBLIC", 4, "y" * 40)]


def test_generic_collector(spark):
    rows = [(3, "x" * 30), (1, "x" * 30), (2, "short"), (4, "  two\n words" + "y" * 30), (5, None), (6, "z" * 501), (7, "w" * 40)]
    df = spark.createDataFrame(rows, "id long, body string")
    got = CO.collect(df, ["id"], F.col("body"), "PUBLIC", 2, F.col("id") != 7).collect()
    assert {r["id"]: r["text"] for r in got} == {1: "x" * 30, 4: "two words" + "y" * 30}


def test_configurations_from_a_table(spark, monkeypatch):
    from veilspark.functions import prompts as P
    grid = P.default_configs(P.MODELS, [p["prompt_name"] for p in P.PROMPTS])
    frame = P.configs_frame(spark, grid)
    assert P.configs_of(frame) == grid
    assert P.configs_of(frame.drop("max_tokens", "endpoint", "name")) == grid
    monkeypatch.setattr(P, "MOST_CONFIGS", len(grid) - 1)
    with pytest.raises(ValueError, match="configurations"):
        P.configs_of(frame)


def test_metric_is_a_parameter_and_answers_are_normalised(spark):
    from veilspark.operators import evaluate as E
    rows = [("SENSITIVE", " public "), ("PUBLIC", "I say SENSITIVE"), ("PUBLIC", "public"), ("SENSITIVE", None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "config_id int, label string, raw string")
    own = E.outcome_utility(F.col("label"), F.col("raw"), 1.0, -5.0, -1.0)
    assert E.mean_utility(df, {"own": own}).first()["own"] == (-5 - 1 + 1 + 1) / 4
