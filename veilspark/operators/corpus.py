"""Corpus building.

Per source: length band on the raw text -> role / keyword filters ->
per-source first-wins dedup on md5(raw) -> clean -> language bucket + quota.
Then all sources are unioned in priority order, stripped, cut below 10 chars
and deduplicated first-wins across sources (first source, then first row).

Skew: first-wins dedup is an aggregation (``min`` over a struct whose first
fields are the order keys), so a fingerprint held by a third of all rows is
pre-aggregated on every mapper and never lands whole in one task. Quotas are
``row_number() <= n`` planned as WindowGroupLimit (partial limit before the
shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import rules as R
from veilspark.functions.text import clean, fingerprint, strip
from veilspark.operators.joins import join_small, spread
from veilspark.operators.splits import first_n_per_group
from veilspark.sources.registry import SOURCES, SourceSpec, existing_reading, spec_rows
from veilspark.sources.tables import table

# a row of a source: documents have turn 0
LOCAL_KEY = ["local_id", "local_turn"]
# the order in which the first of equal texts wins
ORDER = ["source_rank", "bucket_order", *LOCAL_KEY]
MIN_FINAL_CHARS = 10
MOST_BROADCAST_IDS = 1_000_000


def case_id(rank: Column) -> Column:
    """One id for (source, local id, turn): the first 60 bits of their MD5. The
    parts themselves are kept through dedup, quotas and joins."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rank.cast("string"), *[F.col(c).cast("string") for c in LOCAL_KEY])), 1, 15), 16, 10).cast("long")


def length_band(text: Column, lo: int, hi: int | None, inclusive: bool = True) -> Column:
    """Code-point length inside the band, measured before cleaning."""
    n = F.length(text)
    if inclusive:
        c = n >= lo
        return c if hi is None else c & (n <= hi)
    c = n > lo
    return c if hi is None else c & (n < hi)


def keyword_filter(df: DataFrame, include: str | None, exclude: str | None, col: str = "raw") -> DataFrame:
    """Keep rows matching ``include`` and not ``exclude`` (ignore case)."""
    if include:
        df = df.where(R.matches(F.col(col), include, True))
    if exclude:
        df = df.where(~R.matches(F.col(col), exclude, True))
    return df


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the first in ``order``. Written as
    ``min(struct(order..., rest...))`` -- a partial aggregation, so hot keys
    collapse map-side; not ``dropDuplicates`` (arbitrary survivor)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    agg = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_w"))
    return agg.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in order + rest])


def language_bucket(lang: Column, mode: str = "substring") -> tuple[Column, Column]:
    """(EN-eligible, DE-eligible). ``substring`` reproduces the reference
    (any tag containing "en" counts as English); ``exact`` is the one tag;
    ``tags`` takes the tag, its regional forms and the language's name."""
    if mode == "exact":
        return lang == "en", lang == "de"
    if mode == "tags":
        return lang.isin("en", "english") | lang.startswith("en-"), lang.isin("de", "german") | lang.startswith("de-")
    return (F.contains(lang, F.lit("en")) | F.contains(lang, F.lit("english")),
            F.contains(lang, F.lit("de")) | F.contains(lang, F.lit("german")))


def _scan_groups(specs: list[tuple[int, SourceSpec]]) -> dict:
    """Specs (readings that exist) that read the same table the same way share one scan."""
    groups: dict = {}
    for rank, spec in specs:
        key = (spec.table, spec.first_human, spec.id_sql, spec.turn_sql, spec.text_sql, spec.human_role)
        groups.setdefault(key, []).append((rank, spec))
    return groups


def _tagged_rows(spark: SparkSession, sf_dir: str, members: list[tuple[int, SourceSpec]]) -> DataFrame:
    """One scan for all ``members``; each row is tagged with every source
    (source_rank) whose predicate it satisfies -> (source_rank, local_id, raw, lang)."""
    rank0, spec0 = members[0]
    if spec0.first_human:
        rows = spec_rows(spark, sf_dir, spec0.__class__(**{**spec0.__dict__, "where_sql": None, "lang_sql": None}))
        tags = F.array(*[F.lit(r) for r, _ in members])
        return rows.select(F.explode(tags).alias("source_rank"), *LOCAL_KEY, "raw", "lang")
    base = spread(table(spark, sf_dir, spec0.table))
    if spec0.human_role:
        base = base.where(F.col("role") == spec0.human_role)
    tag_items = [F.when(F.expr(sp.where_sql), F.lit(r)) if sp.where_sql else F.lit(r) for r, sp in members]
    lang_col = F.lit(None).cast("string")
    for r, sp in members:
        if sp.lang_sql:
            lang_col = F.when(F.col("source_rank") == r, F.expr(sp.lang_sql)).otherwise(lang_col)
    t = base.select(F.expr(spec0.id_sql).cast("long").alias("local_id"),
                    F.expr(spec0.turn_sql).cast("long").alias("local_turn"), F.expr(spec0.text_sql).alias("raw"),
                    *[c for c in ("lang",) if c in base.columns],
                    F.filter(F.array(*tag_items), lambda x: x.isNotNull()).alias("_tags"))
    t = t.select(F.explode("_tags").alias("source_rank"), *LOCAL_KEY, "raw",
                 *[c for c in ("lang",) if c in base.columns])
    if "lang" not in t.columns:
        t = t.withColumn("lang", F.lit(None).cast("string"))
    return t.withColumn("lang", lang_col)


def _per_source(col_rank, specs: list[tuple[int, SourceSpec]], fn, default):
    out = None
    for r, sp in specs:
        v = fn(sp)
        if v is None:
            continue
        out = F.when(col_rank == r, v) if out is None else out.when(col_rank == r, v)
    return default if out is None else out.otherwise(default)


def _collect(spark: SparkSession, sf_dir: str, specs: list[tuple[int, SourceSpec]]) -> DataFrame | None:
    """All sources at once: band -> keywords -> per-source first-wins dedup of ids
    -> quotas (ids chosen per source) -> their texts fetched and cleaned."""
    # each source by the reading whose table exists: its band, filters, quota and cut hold
    specs = [(r, reading) for r, sp in specs if (reading := existing_reading(spark, sf_dir, sp)[0]) is not None]
    if not specs:
        return None
    parts = [_tagged_rows(spark, sf_dir, m) for m in _scan_groups(specs).values()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rk = F.col("source_rank")
    band = _per_source(rk, specs, lambda sp: length_band(F.col("raw"), sp.min_len, sp.max_len, sp.inclusive),
                       F.lit(False))
    kw = _per_source(rk, specs, lambda sp: (
        (R.matches(F.col("raw"), sp.include, True) if sp.include else F.lit(True)) &
        (~R.matches(F.col("raw"), sp.exclude, True) if sp.exclude else F.lit(True))
    ) if (sp.include or sp.exclude) else None, F.lit(True))
    tagged = rows
    texts = tagged.where(F.col("raw").isNotNull() & band & kw)
    # ids only from here: texts stay where they are until the quotas have chosen.
    # The quota picks and the DE spill all read these rows: land them once.
    keyed = texts.select("source_rank", fingerprint(F.col("raw")).alias("fp"), *LOCAL_KEY, "lang")
    from veilspark.operators.cascade import land
    rows = land(first_wins(keyed, ["source_rank", "fp"], LOCAL_KEY), "corpus-ids")
    order, row_key = [F.col(c) for c in LOCAL_KEY], ["source_rank", *LOCAL_KEY]
    whole_key = [*row_key, "fp"]  # an id may come with several texts

    def pick(sub: DataFrame, n_of, group_specs) -> DataFrame:
        # first n per source on (source_rank, local_id) only; the window limit
        # is the largest quota, the per-source quota is applied after it
        n_max = max(n_of(sp) for _, sp in group_specs)
        ranked = first_n_per_group(sub.select(*whole_key), ["source_rank"], [*order, F.col("fp")], n_max)
        n_col = _per_source(rk, group_specs, lambda sp: F.lit(n_of(sp)), F.lit(0))
        return ranked.where(F.col("pos") <= n_col).select(*whole_key)

    total = [(r, sp) for r, sp in specs if sp.lang_quotas is None or sp.lang_sql is None]
    langq = [(r, sp) for r, sp in specs if not (sp.lang_quotas is None or sp.lang_sql is None)]
    quota_total = [(r, sp) for r, sp in total
                   if sp.quota is not None or sp.lang_quotas is not None]
    open_ranks = [r for r, sp in total if sp.quota is None and sp.lang_quotas is None]
    chosen = []
    if quota_total:
        n_tot = lambda sp: sp.quota if sp.quota is not None else sum(sp.lang_quotas)
        ids = pick(rows.where(rk.isin([r for r, _ in quota_total])), n_tot, quota_total)
        chosen.append(ids.withColumn("bucket_order", F.lit(0)).withColumn("bucket", F.lit(None).cast("string")))
    if open_ranks:
        ids = rows.where(rk.isin(open_ranks)).select(*whole_key)
        chosen.append(ids.withColumn("bucket_order", F.lit(0)).withColumn("bucket", F.lit(None).cast("string")))
    if langq:
        mode = {r: sp.lang_mode for r, sp in langq}
        en_ok = _per_source(rk, langq, lambda sp: language_bucket(F.col("lang"), mode[[r for r, s in langq if s is sp][0]])[0], F.lit(False))
        de_ok = _per_source(rk, langq, lambda sp: language_bucket(F.col("lang"), mode[[r for r, s in langq if s is sp][0]])[1], F.lit(False))
        lq = rows.where(rk.isin([r for r, _ in langq]))
        en_ids = pick(lq.where(en_ok), lambda sp: sp.lang_quotas[0], langq)
        # DE: qualifies and was not taken while the EN quota was open
        de_rows = lq.where(de_ok).join(F.broadcast(en_ids), whole_key, "left_anti")
        de_ids = pick(de_rows, lambda sp: sp.lang_quotas[1], langq)
        chosen.append(en_ids.withColumn("bucket_order", F.lit(0)).withColumn("bucket", F.lit("en")))
        chosen.append(de_ids.withColumn("bucket_order", F.lit(1)).withColumn("bucket", F.lit("de")))
    ids = chosen[0]
    for c in chosen[1:]:
        ids = ids.unionByName(c)
    # the chosen ids fetch their texts (bands and keywords hold, since the
    # fingerprint is theirs); rows that repeat an id and its text are one
    found = join_small(tagged.drop("lang"), ids, row_key, "inner").where(fingerprint(F.col("raw")) == F.col("fp"))
    shown = _per_source(rk, specs, lambda sp: None if sp.cut is None else F.substring(clean(F.col("raw")), 1, sp.cut), clean(F.col("raw")))
    out = found.withColumn("text", shown).drop("raw").dropDuplicates(whole_key)
    label = _per_source(rk, specs, lambda sp: F.lit(sp.label), F.lit(None).cast("string"))
    name = _per_source(rk, specs, lambda sp: F.lit(sp.name), F.lit(None).cast("string"))
    return out.select(case_id(rk).alias("case_id"), *LOCAL_KEY, "text", label.alias("label"), name.alias("source"),
                      rk.cast("int").alias("source_rank"), F.col("bucket").alias("lang"), "bucket_order")


def collect(df: DataFrame, ids: list[str], text: Column, label: str, n: int, keep: Column | None = None,
            lo: int = 25, hi: int = 500) -> DataFrame:
    """C7 over any DataFrame and Columns: rows that ``keep`` holds for and whose
    text lies in the band, the first of equal texts, cleaned, the first ``n`` in
    the order of ``ids`` (a quota, so a feature)."""
    rows = df.where(keep) if keep is not None else df
    rows = rows.select(*ids, text.alias("raw")).where(F.col("raw").isNotNull() & length_band(F.col("raw"), lo, hi))
    first = first_wins(rows.select(*ids, fingerprint(F.col("raw")).alias("fp")), ["fp"], ids).orderBy(*ids).limit(n)
    # at most n ids come back to the texts
    chosen = F.broadcast(first.select(*ids)) if n <= MOST_BROADCAST_IDS else first.select(*ids)
    return rows.join(chosen, ids, "left_semi").select(*ids, clean(F.col("raw")).alias("text"), F.lit(label).alias("label"))


def collect_source(spark: SparkSession, sf_dir: str, spec: SourceSpec, rank: int) -> DataFrame | None:
    """One source's contribution (text cleaned, not yet stripped)."""
    return _collect(spark, sf_dir, [(rank, spec)])


def union_sources(spark: SparkSession, sf_dir: str, specs: list[SourceSpec] | None = None, first_rank: int = 1) -> DataFrame:
    """A5: all sources in priority order (provenance = source, source_rank, from
    ``first_rank`` on); each table is scanned once for all the sources that read it."""
    specs = specs or SOURCES
    return _collect(spark, sf_dir, list(enumerate(specs, start=first_rank)))


def candidates(union: DataFrame) -> DataFrame:
    """Stripped texts of the least length or more, with their fingerprint."""
    u = union.withColumn("text", strip(F.col("text")))
    return u.where(F.length("text") >= MIN_FINAL_CHARS).withColumn("fp", fingerprint(F.col("text")))


def build_corpus(spark: SparkSession, sf_dir: str, specs: list[SourceSpec] | None = None,
                 labelled: DataFrame | None = None) -> DataFrame:
    """Whole corpus: union -> strip -> length >= 10 -> first-wins dedup on
    md5(stripped) by (source_rank, bucket_order, local_id, local_turn).
    ``labelled`` (case_id, text, label) are case sets that already have labels;
    they come last, as a source without band or quota (A5, J8)."""
    u = union_sources(spark, sf_dir, specs)
    if labelled is not None:
        rank = F.lit(len(specs or SOURCES) + 1)
        rows = labelled.select(F.col("case_id").cast("long").alias("local_id"), F.lit(0).cast("long").alias("local_turn"), "text", "label")
        rows = rows.select(case_id(rank).alias("case_id"), *LOCAL_KEY, "text", "label", F.lit("labelled").alias("source"),
                           rank.cast("int").alias("source_rank"), F.lit(None).cast("string").alias("lang"),
                           F.lit(0).alias("bucket_order"))
        u = rows if u is None else u.unionByName(rows)
    d = first_wins(candidates(u), ["fp"], ORDER)
    return d.select("case_id", "text", "label", "source", "source_rank", "lang", "fp")


def first_user_message(conversations: DataFrame, role: str = "user") -> DataFrame:
    """The first human turn of each conversation (arg-min by turn)."""
    return conversations.where(F.col("role") == role).groupBy("conv_id") \
        .agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))
