"""Quotas that bind (EN -> DE spill, totals) against the DuckDB twin."""

import dataclasses

import duckdb
from pyspark.sql import functions as F

from veilspark.operators import cascade, splits
from veilspark.operators import corpus as CO
from veilspark.plans import oracle as O
from veilspark.sources.registry import SOURCES
from veilspark.sources.tables import TABLES

SF01 = "/root/testdata/sf0.01"


def test_binding_quotas_match_sql(spark):
    specs = [dataclasses.replace(SOURCES[0], lang_quotas=(3, 2), min_len=10, max_len=5000),
             dataclasses.replace(SOURCES[2], quota=4, min_len=10, max_len=5000),
             dataclasses.replace(SOURCES[7], quota=5)]
    got = sorted((r["case_id"], r["source"], r["lang"]) for r in
                 CO.union_sources(spark, SF01, specs).select("case_id", "source", "lang").collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    want = sorted(con.execute(f"SELECT case_id, source, lang FROM ({O.union_sources_sql(specs)})").fetchall())
    assert got == want
    assert sum(1 for g in got if g[2] == "en") == 3 and sum(1 for g in got if g[2] == "de") == 2
    union = CO.union_sources(spark, SF01, specs)
    plan = union._jdf.queryExecution().executedPlan().toString()
    # the chosen ids come from the landed ones by broadcast; each table is read once more, for their texts alone
    assert "BroadcastHashJoin" in plan and plan.count("documents.parquet") == 1 and plan.count("conversations.parquet") == 1


def test_no_text_is_shuffled_to_find_the_ids(spark, monkeypatch):
    seen, land = [], cascade.land
    monkeypatch.setattr(cascade, "land", lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or land(df, name))
    CO.union_sources(spark, SF01)
    plan = dict(seen)["corpus-ids"]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(source_rank" in line]
    aggregates = [line for line in plan.splitlines() if "Aggregate(key=[source_rank" in line]
    assert exchanges and aggregates and not any("raw#" in line for line in aggregates)


def test_equal_ids_and_repeated_rows(spark, tmp_path):
    spec = dataclasses.replace(SOURCES[5], where_sql=None, quota=5)
    rows = [(1, "the first text of an id"), (1, "another text of the same id"), (1, "the first text of an id"), (2, "the first text of an id"), (3, "too short"),
            (4, None), (5, "a third text, of its own")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = CO.union_sources(spark, str(tmp_path), [spec]).select("local_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "another text of the same id"), (1, "the first text of an id"), (5, "a third text, of its own")]


def test_a_hot_group_leaves_few_rows_for_the_last_window(spark):
    df = spark.range(0, 40000, 1, 16).select(F.lit("hot").alias("g"), "id")
    got = splits.first_n_per_group(df, ["g"], [F.col("id")], 20)
    assert sorted(r["id"] for r in got.collect()) == list(range(20))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 and "_bucket" in plan  # limited by bucket, then by group, each before its shuffle
