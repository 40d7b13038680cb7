"""Corpus source registry (A2-A5, C1-C8 parameters) as data.

Each source is a ``SourceSpec``: which table, how to get (id, text, lang), a
row predicate, the label it contributes, its length band, keyword filters and
quotas. Expressions are plain SQL text that Spark (``F.expr``) and the DuckDB
oracle read the same way, so one spec drives both.

The bands, quotas and labels are the reference's collector parameters (fixed
values below); the mapping onto the driver tables is ours: documents stand in
for the PII / story / legal / coding corpora (split by their ``source`` tag),
``benchmark`` for the factual-QA corpus, ``conversations`` for the chat
corpora. Conversations carry no language tag, so their EN/DE quotas are
applied as one total quota (documented deviation).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.tables import table

LANG_SQL = "lower(coalesce(nullif(lang, ''), ''))"


@dataclass(frozen=True)
class SourceSpec:
    name: str
    table: str
    label: str
    min_len: int
    max_len: int | None
    inclusive: bool = True
    id_sql: str = "doc_id"
    turn_sql: str = "0"                           # second part of the id, where one is not enough
    text_sql: str = "coalesce(nullif(text, ''))"
    lang_sql: str | None = None
    where_sql: str | None = None
    quota: int | None = None                      # total quota
    lang_quotas: tuple[int, int] | None = None    # (EN, DE)
    lang_mode: str = "substring"                  # substring | exact
    human_role: str | None = None                 # role filter (C4)
    first_human: bool = False                     # first human turn per conversation (C8)
    include: str | None = None                    # keyword pattern key (C5)
    exclude: str | None = None                    # keyword pattern key (C6)
    cut: int | None = None                        # code points kept of a cleaned text
    # read instead, in this order, where ``table`` is missing (A4): tables read by the
    # same rules, or sources with a band, filters, quota and cut of their own
    other_tables: tuple[str | SourceSpec, ...] = ()


def _srcs(lo: int, hi: int) -> str:
    return "source IN (" + ", ".join(f"'src{i}'" for i in range(lo, hi + 1)) + ")"


# ----------------------------------------------------------------------------
# FIXED VALUES -- collector parameters (label, length band, quotas, filters)
# in the reference's priority order; table mapping is ours.
# ----------------------------------------------------------------------------
SOURCES: list[SourceSpec] = [
    SourceSpec("pii_multilingual", "documents", "SENSITIVE", 30, 500, where_sql=_srcs(0, 4),
               lang_sql=LANG_SQL, lang_quotas=(400, 200)),
    SourceSpec("pii_masking", "documents", "SENSITIVE", 30, 500, where_sql=_srcs(5, 9),
               lang_sql=LANG_SQL, lang_quotas=(200, 150)),
    SourceSpec("personal_stories", "documents", "SENSITIVE", 30, 500, where_sql=_srcs(10, 12), quota=200),
    SourceSpec("legal_posts", "documents", "SENSITIVE", 20, 500, where_sql=_srcs(13, 14), quota=150),
    SourceSpec("assistant_personal", "conversations", "SENSITIVE", 25, 500, id_sql="conv_id", turn_sql="turn",
               human_role="user", include="kw_personal", quota=200),
    SourceSpec("coding_questions", "documents", "PUBLIC", 15, 300, where_sql=_srcs(15, 19), quota=250),
    SourceSpec("factual_qa", "benchmark", "PUBLIC", 10, 300, id_sql="item_id", quota=200),
    SourceSpec("chat_first_user", "conversations", "PUBLIC", 20, 400, inclusive=False, id_sql="conv_id",
               human_role="user", first_human=True, quota=250),
    SourceSpec("chat_first_human", "conversations", "PUBLIC", 15, 400, inclusive=False, id_sql="conv_id",
               human_role="user", first_human=True, quota=150),
    SourceSpec("assistant_topics", "conversations", "PUBLIC", 20, 400, id_sql="conv_id", turn_sql="turn",
               human_role="user", include="kw_topic", exclude="kw_first_person", quota=200),
]


def readings(spec: SourceSpec) -> list[SourceSpec]:
    """The ways to read a source, in order: each a source by itself, under its name and label."""
    own = replace(spec, other_tables=())
    return [own, *[replace(o, name=spec.name, label=spec.label, other_tables=()) if isinstance(o, SourceSpec) else replace(own, table=o)
                   for o in spec.other_tables]]


def existing_reading(spark: SparkSession, sf_dir: str, spec: SourceSpec) -> tuple[SourceSpec | None, DataFrame | None]:
    """The first of the spec's readings whose table exists, and that table (A4).
    Only a missing *path* counts as absent; a failure while reading an existing
    table is raised."""
    for reading in readings(spec):
        try:
            return reading, table(spark, sf_dir, reading.table)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None, None


def source_status(spark: SparkSession, sf_dir: str, specs: list[SourceSpec] | None = None) -> DataFrame:
    """M5: what each source read: ``source, table_read, status, n_rows``. Status is
    ``ok``, ``fallback`` (another table than the first), ``empty`` or ``missing``."""
    out = None
    for spec in specs or SOURCES:
        reading, _ = existing_reading(spark, sf_dir, spec)
        if reading is None:
            one = spark.range(1).select(F.lit(spec.name).alias("source"), F.lit(None).cast("string").alias("table_read"),
                                        F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n_rows"))
        else:
            found = F.lit("ok" if reading.table == spec.table else "fallback")
            one = spec_rows(spark, sf_dir, reading).agg(F.count(F.lit(1)).alias("n_rows")) \
                .select(F.lit(spec.name).alias("source"), F.lit(reading.table).alias("table_read"),
                        F.when(F.col("n_rows") > 0, found).otherwise(F.lit("empty")).alias("status"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def spec_rows(spark: SparkSession, sf_dir: str, spec: SourceSpec) -> DataFrame | None:
    """(local_id, local_turn, raw, lang) rows of one source, or ``None`` when the table
    and its alternatives are missing (A4: an empty source)."""
    spec, base = existing_reading(spark, sf_dir, spec)
    if base is None:
        return None
    if spec.where_sql:
        base = base.where(F.expr(spec.where_sql))
    if spec.human_role:
        base = base.where(F.col("role") == spec.human_role)
    lang = F.expr(spec.lang_sql) if spec.lang_sql else F.lit(None).cast("string")
    if spec.first_human:
        # The first human turn of each conversation (partial aggregation)
        return base.groupBy("conv_id").agg(F.min_by("text", "turn").alias("raw")) \
            .select(F.col("conv_id").cast("long").alias("local_id"), F.lit(0).cast("long").alias("local_turn"), "raw",
                    F.lit(None).cast("string").alias("lang"))
    return base.select(F.expr(spec.id_sql).cast("long").alias("local_id"), F.expr(spec.turn_sql).cast("long").alias("local_turn"),
                       F.expr(spec.text_sql).alias("raw"), lang.alias("lang"))
