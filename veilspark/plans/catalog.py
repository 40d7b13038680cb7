"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the driver tables, plus its DuckDB twin
where SQL can express it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import prompts as P
from veilspark.functions.answers import outcome
from veilspark.operators import classify as C
from veilspark.operators import cascade as K
from veilspark.operators import evaluate as E
from veilspark.plans import oracle as O
from veilspark.sources.cases import labelled_cases
from veilspark.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# v4 grid: 2 models x prompts D, F, G (config ids 1..6)
V4_CONFIGS = P.default_configs()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and raw web pages as one message table (kind, msg_id, text);
    pages carry code-like text that trips the guards."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("msg_id"), "text")
    p = table(spark, sf_dir, "pages", ["page_id", "html"]).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("msg_id"), F.col("html").alias("text"))
    return d.unionByName(p)


def predictions(spark: SparkSession, sf_dir: str, rule_set: str = "v4", configs=None,
                keep_text: bool = False, strip_think: bool = True) -> DataFrame:
    pred = K.cascade(labelled_cases(spark, sf_dir), configs or V4_CONFIGS, rule_set,
                     keep_text=keep_text, strip_think=strip_think)
    return pred.withColumn("outcome", outcome(F.col("label"), F.col("predicted")))


# ---------------------------------------------------------------- A: sources
@register("load_labelled_cases", f"SELECT case_id, text, label, source, source_rank, lang FROM ({O.CASES})")
def load_labelled_cases(spark, sf_dir):
    return labelled_cases(spark, sf_dir)


# ------------------------------------------------- D: classification stages
def _classify_query(rule_set: str):
    def q(spark, sf_dir):
        c = C.classify(messages(spark, sf_dir), rule_set)
        return c.select("kind", "msg_id", "verdict", F.array_join("matches", ",").alias("matches"))
    return q


for _rs in ("v0", "v1", "v2", "v3", "v4"):
    register(f"classify_rules_{_rs}",
             f"SELECT kind, msg_id, verdict, array_to_string(matches, ',') AS matches "
             f"FROM ({O.classify_select(_rs, '(' + O.MESSAGES + ')')})")(_classify_query(_rs))


@register("classify_rules_fast",
          f"SELECT kind, msg_id, (NOT {O.any_rx('text', ('guard_narrow',))} AND "
          f"{O.any_rx('text', [k for _, k in O.R.RULE_SETS['v4'].tiers[0]], False)}) "
          f"AS rule_hit FROM ({O.MESSAGES})")
def classify_rules_fast(spark, sf_dir):
    return C.classify_fast(messages(spark, sf_dir), "v4").select("kind", "msg_id", "rule_hit")


@register("rules_only_baseline",
          f"""SELECT case_id, label, CASE WHEN verdict = 'UNCERTAIN' THEN 'PUBLIC' ELSE verdict END AS predicted,
              CASE WHEN verdict = 'UNCERTAIN' THEN 'regex:no_match' ELSE 'regex:' || array_to_string(matches, ',') END AS method
              FROM ({O.classify_select('v1', '(' + O.CASES + ')')})""")
def rules_only_baseline(spark, sf_dir):
    return C.rules_only(labelled_cases(spark, sf_dir), "v1").select("case_id", "label", "predicted", "method")


@register("hybrid_cascade",
          f"SELECT case_id, config_id, label, predicted, method, latency_ms, {O.outcome_sql()} AS outcome "
          f"FROM ({O.cascade_sql(V4_CONFIGS)})")
def hybrid_cascade(spark, sf_dir):
    return predictions(spark, sf_dir).select("case_id", "config_id", "label", "predicted", "method",
                                             "latency_ms", "outcome")


# ------------------------------------------------------- F: aggregations
_METRIC_COLS = ("config_id, total, n_sensitive, n_public, correct, false_negatives, false_positives, llm_calls, "
                "total_latency_ms, accuracy, fnr, fpr, accuracy_pct, fnr_pct, fpr_pct, avg_latency_ms, total_time_s")


def v4_metrics(spark, sf_dir, definition: str = "v1") -> DataFrame:
    return E.metrics(E.confusion(predictions(spark, sf_dir), ("config_id",), definition))


@register("classifier_metrics",
          f"SELECT {_METRIC_COLS} FROM ({O.metrics_sql(O.confusion_sql(O.cascade_sql(V4_CONFIGS)))})")
def classifier_metrics(spark, sf_dir):
    return v4_metrics(spark, sf_dir).select(*[c.strip() for c in _METRIC_COLS.split(",")])


# ------------------------------------------------------- C: detectors
from veilspark.functions import rules as R  # noqa: E402
from veilspark.sources.derived import probe_text, probe_text_sql  # noqa: E402

PROBE_DOCS_SQL = f"SELECT doc_id, {probe_text_sql('text', 'doc_id')} AS text FROM documents"


def probe_documents(spark, sf_dir) -> DataFrame:
    from veilspark.operators.joins import spread
    return spread(table(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        "doc_id", probe_text("text", "doc_id").alias("text"))


def _detector_query(key: str, ic: bool):
    def q(spark, sf_dir):
        return probe_documents(spark, sf_dir).select("doc_id", R.matches(F.col("text"), key, ic).alias("hit"))
    return q


for _name, (_key, _ic) in R.DETECTORS.items():
    register(f"detect_{_name}", f"SELECT doc_id, {O.rx('text', _key, _ic)} AS hit FROM ({PROBE_DOCS_SQL})")(
        _detector_query(_key, _ic))


def _guard_query(kind: str):
    def q(spark, sf_dir):
        p = table(spark, sf_dir, "pages", ["page_id", "html"])
        return p.select("page_id", C.guard(F.col("html"), kind).alias("hit"))
    return q


for _g in ("v1", "broad", "narrow"):
    register(f"guard_{_g}", f"SELECT page_id, {O.any_rx('html', R.GUARDS[_g], True)} AS hit FROM pages")(
        _guard_query(_g))


# ------------------------------------------------------- B/C/E/H: corpus
from veilspark.functions import text as TX  # noqa: E402
from veilspark.operators import corpus as CO  # noqa: E402
from veilspark.operators import splits as S  # noqa: E402
from veilspark.sources.registry import SOURCES  # noqa: E402

DOCS_AS_CASES_SQL = ("SELECT doc_id AS case_id, text, source, "
                     "TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS source_rank, lang FROM documents")


def docs_as_cases(spark, sf_dir) -> DataFrame:
    from veilspark.sources.cases import source_rank_of
    from veilspark.operators.joins import spread
    d = spread(table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"]))
    return d.select(F.col("doc_id").alias("case_id"), "text", "source",
                    source_rank_of(F.col("source")).alias("source_rank"), "lang")


def deduped_docs(spark, sf_dir) -> DataFrame:
    """E1 over the documents: first row per md5(strip(text)) by (source_rank, case_id)."""
    d = docs_as_cases(spark, sf_dir).withColumn("fp", TX.fingerprint(TX.strip(F.col("text"))))
    return CO.first_wins(d.drop("text"), ["fp"], ["source_rank", "case_id"])


DEDUP_DOCS_SQL = (f"SELECT * EXCLUDE (text) FROM (SELECT *, md5({O.strip_sql('text')}) AS fp FROM ({DOCS_AS_CASES_SQL})) "
                  f"QUALIFY row_number() OVER (PARTITION BY fp ORDER BY source_rank, case_id) = 1")


@register("clean_text", f"SELECT doc_id, {O.clean_sql('text')} AS cleaned, CAST(length({O.clean_sql('text')}) AS INTEGER) AS n_clean "
                        f"FROM documents")
def clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", TX.clean(F.col("text")).alias("cleaned"))
    return d.withColumn("n_clean", F.length("cleaned"))


@register("text_fingerprint", f"SELECT doc_id, md5(text) AS fp, md5({O.strip_sql('text')}) AS fp_stripped FROM documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        "doc_id", TX.fingerprint(F.col("text")).alias("fp"), TX.fingerprint(TX.strip(F.col("text"))).alias("fp_stripped"))


_TITLE = r"<title>(.*?)</title>"


@register("coalesce_nonempty",
          f"SELECT page_id, coalesce(nullif(regexp_extract(html, {O.lit(_TITLE)}, 1), ''), nullif(url, '')) AS name "
          f"FROM pages")
def coalesce_nonempty(spark, sf_dir):
    p = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return p.select("page_id", TX.first_nonempty(F.regexp_extract("html", _TITLE, 1), F.col("url")).alias("name"))


def _band_case_sql() -> str:
    arms = [f"WHEN {s.where_sql} THEN ({O.band_sql('text', s.min_len, s.max_len, s.inclusive)})"
            for s in SOURCES if s.table == "documents"]
    return "CASE " + " ".join(arms) + " ELSE false END"


@register("length_band", f"SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars, {_band_case_sql()} AS in_band FROM documents")
def length_band(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    band = None
    for s in SOURCES:
        if s.table != "documents":
            continue
        c = CO.length_band(F.col("text"), s.min_len, s.max_len, s.inclusive)
        band = F.when(F.expr(s.where_sql), c) if band is None else band.when(F.expr(s.where_sql), c)
    return d.select("doc_id", "source", F.length("text").alias("n_chars"), band.otherwise(F.lit(False)).alias("in_band"))


_LANG = "lower(coalesce(nullif(lang, ''), ''))"


@register("language_bucket",
          f"SELECT doc_id, lang, (contains({_LANG}, 'en') OR contains({_LANG}, 'english')) AS en_ok, "
          f"(contains({_LANG}, 'de') OR contains({_LANG}, 'german')) AS de_ok, "
          f"{_LANG} = 'en' AS en_exact, {_LANG} = 'de' AS de_exact, "
          f"{_LANG} IN ('en', 'english') OR starts_with({_LANG}, 'en-') AS en_tag, "
          f"{_LANG} IN ('de', 'german') OR starts_with({_LANG}, 'de-') AS de_tag FROM documents")
def language_bucket(spark, sf_dir):
    from veilspark.sources.registry import LANG_SQL
    d = table(spark, sf_dir, "documents", ["doc_id", "lang"]).withColumn("_l", F.expr(LANG_SQL))
    en, de = CO.language_bucket(F.col("_l"), "substring")
    en_x, de_x = CO.language_bucket(F.col("_l"), "exact")
    en_t, de_t = CO.language_bucket(F.col("_l"), "tags")
    return d.select("doc_id", "lang", en.alias("en_ok"), de.alias("de_ok"), en_x.alias("en_exact"), de_x.alias("de_exact"),
                    en_t.alias("en_tag"), de_t.alias("de_tag"))


@register("role_filter", "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_chars FROM conversations WHERE role = 'user'")
def role_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.where(F.col("role") == "user").select("conv_id", "turn", F.length("text").alias("n_chars"))


_CONV_PROBE_SQL = (f"SELECT conv_id, turn, {probe_text_sql('text', '(conv_id * 7 + turn)')} AS text "
                   f"FROM conversations WHERE role = 'user'")


def _conv_probe(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    return c.select("conv_id", "turn", probe_text("text", "(conv_id * 7 + turn)").alias("raw"))


@register("keyword_include", f"SELECT conv_id, turn FROM ({_CONV_PROBE_SQL}) WHERE {O.rx('text', 'kw_personal', True)}")
def keyword_include(spark, sf_dir):
    return CO.keyword_filter(_conv_probe(spark, sf_dir), "kw_personal", None).select("conv_id", "turn")


@register("keyword_include_exclude",
          f"SELECT conv_id, turn FROM ({_CONV_PROBE_SQL}) WHERE {O.rx('text', 'kw_topic', True)} "
          f"AND NOT {O.rx('text', 'kw_first_person', True)}")
def keyword_include_exclude(spark, sf_dir):
    return CO.keyword_filter(_conv_probe(spark, sf_dir), "kw_topic", "kw_first_person").select("conv_id", "turn")


@register("first_user_message",
          "SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations "
          "WHERE role = 'user' GROUP BY conv_id")
def first_user_message(spark, sf_dir):
    return CO.first_user_message(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


@register("collect_source", f"SELECT case_id, text, label, source, lang FROM ({O.collect_source_sql(SOURCES[0], 1)})")
def collect_source(spark, sf_dir):
    return CO.collect_source(spark, sf_dir, SOURCES[0], 1).select("case_id", "text", "label", "source", "lang")


@register("union_sources",
          f"SELECT case_id, label, source, source_rank, lang, CAST(length(text) AS INTEGER) AS n_chars FROM ({O.union_sources_sql()})")
def union_sources(spark, sf_dir):
    return CO.union_sources(spark, sf_dir).select("case_id", "label", "source", "source_rank", "lang",
                                                  F.length("text").alias("n_chars"))


@register("build_corpus", f"SELECT case_id, label, source, lang, fp FROM ({O.corpus_sql()})")
def build_corpus(spark, sf_dir):
    return CO.build_corpus(spark, sf_dir).select("case_id", "label", "source", "lang", "fp")


from veilspark.operators import corpus_index as CI  # noqa: E402


@register("build_corpus_in_batches", f"SELECT case_id, label, source, lang, fp FROM ({O.corpus_sql()})")
def build_corpus_in_batches(spark, sf_dir):
    """E1 + A5: the first five sources, then the others against the kept index,
    the second batch twice; the same corpus as all sources at once."""
    index = CI.CorpusIndex(K.scratch_path(spark, "corpus-index"), buckets=8, blocks=16)
    first, rest = SOURCES[:5], SOURCES[5:]
    CI.add(CO.candidates(CO.union_sources(spark, sf_dir, first)), index, "first")
    later = CO.candidates(CO.union_sources(spark, sf_dir, rest, 1 + len(first)))
    CI.add(later, index, "rest")
    CI.add(later, index, "rest")
    return index.corpus(spark).select("case_id", "label", "source", "lang", "fp")


@register("corpus_composition",
          f"SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, "
          f"CAST(count(*) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_pct "
          f"FROM ({O.corpus_sql()}) GROUP BY label")
def corpus_composition(spark, sf_dir):
    return E.corpus_composition(CO.build_corpus(spark, sf_dir)).select(
        "label", "n", F.col("total").cast("long").alias("total"), "share_pct")


@register("dedup_first_wins", f"SELECT case_id, source, fp FROM ({DEDUP_DOCS_SQL})")
def dedup_first_wins(spark, sf_dir):
    return deduped_docs(spark, sf_dir).select("case_id", "source", "fp")


@register("dedup_within_source",
          "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(text) "
          "ORDER BY doc_id) = 1")
def dedup_within_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).withColumn("fp", TX.fingerprint(F.col("text")))
    return CO.first_wins(d.select("doc_id", "source", "fp"), ["source", "fp"], ["doc_id"]).select("doc_id", "source")


QUOTA_N = 3


@register("source_quota",
          f"SELECT doc_id, source, lang, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS INTEGER) AS pos "
          f"FROM documents QUALIFY pos <= {QUOTA_N}")
def source_quota(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "lang"])
    return S.first_n_per_group(d, ["source", "lang"], [F.col("doc_id")], QUOTA_N)


# ------------------------------------------------------------ J: splits
def split_docs(spark, sf_dir) -> DataFrame:
    return S.split_train_dev_test(deduped_docs(spark, sf_dir), "case_id", 42)


SPLIT_DOCS_SQL = O.split_sql(DEDUP_DOCS_SQL)


@register("split_train_dev_test", f"SELECT case_id, split, rank FROM ({SPLIT_DOCS_SQL})")
def split_train_dev_test(spark, sf_dir):
    return split_docs(spark, sf_dir).select("case_id", "split", "rank")


@register("split_holdout", f"SELECT case_id, split, rank FROM ({O.split_sql(DEDUP_DOCS_SQL, kind='50/50')})")
def split_holdout(spark, sf_dir):
    return S.split_holdout(deduped_docs(spark, sf_dir), "case_id", 42).select("case_id", "split", "rank")


@register("train_head", f"SELECT case_id, rank FROM ({SPLIT_DOCS_SQL}) WHERE split = 'train' AND rank <= 200")
def train_head(spark, sf_dir):
    """The first 200 training cases (train occupies ranks 1..floor(.6n))."""
    return split_docs(spark, sf_dir).where((F.col("split") == "train") & (F.col("rank") <= 200)).select("case_id", "rank")


@register("seeded_sample",
          f"SELECT case_id FROM ({SPLIT_DOCS_SQL}) WHERE split = 'dev' "
          f"ORDER BY {O.seeded_hash_sql('case_id', 42, 1)}, case_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """100 dev cases by smallest md5(seed|round|id)."""
    dev = split_docs(spark, sf_dir).where(F.col("split") == "dev")
    return S.seeded_sample(dev, 100, "case_id", 42, 1).select("case_id")


_ROUNDS = list(range(1, 13))


@register("seeded_samples",
          f"SELECT r AS round, case_id FROM ({SPLIT_DOCS_SQL}), (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS r) WHERE split = 'dev' "
          f"QUALIFY row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', '42', CAST(r AS VARCHAR), CAST(case_id AS VARCHAR))), case_id) <= 100")
def seeded_samples(spark, sf_dir):
    """The dev samples of all 12 rounds from one reading of the ids."""
    dev = split_docs(spark, sf_dir).where(F.col("split") == "dev").select("case_id")
    return S.seeded_samples(K.land(dev, "dev"), 100, _ROUNDS, "case_id", 42)


from veilspark.sources import shuffled as SH  # noqa: E402


@register("write_shuffled_corpus",
          f"SELECT case_id, md5(text) AS text_md5, split, rank AS ordinal FROM ({O.split_sql(DOCS_AS_CASES_SQL)})")
def write_shuffled_corpus(spark, sf_dir):
    """J3 + H2: all documents written in the seeded order with their split, and
    read back; the ordinals come from where the rows lie on disk."""
    docs = docs_as_cases(spark, sf_dir).select("case_id", "text")
    back = SH.write_shuffled(S.label_train_dev_test(docs, "case_id", 42), rows_per_file=20_000)
    return back.select("case_id", F.md5("text").alias("text_md5"), "split", "ordinal")


_LAB_DOCS_SQL = (f"SELECT s.*, CASE WHEN l.toxic = 1 THEN 'SENSITIVE' ELSE 'PUBLIC' END AS label "
                 f"FROM ({SPLIT_DOCS_SQL}) s JOIN labels l ON s.case_id = l.doc_id")


@register("balanced_sample",
          f"""WITH t AS (SELECT * FROM ({_LAB_DOCS_SQL}) WHERE split = 'train'),
              k AS (SELECT least(min(n), 200) AS k FROM (SELECT label, count(*) AS n FROM t GROUP BY label))
              SELECT case_id, label, pos FROM (SELECT case_id, label,
                 CAST(row_number() OVER (PARTITION BY label ORDER BY rank) AS INTEGER) AS pos FROM t), k WHERE pos <= k.k""")
def balanced_sample(spark, sf_dir):
    from veilspark.operators.joins import join_small
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"]).select(
        F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "SENSITIVE").otherwise("PUBLIC").alias("label"))
    train = join_small(split_docs(spark, sf_dir).where(F.col("split") == "train"), labels, "case_id")
    return S.balanced_sample(train, 200).select("case_id", "label", "pos")


# ------------------------------------------- B/D/E/F/H: scoring & evaluation
from veilspark.functions import answers as A  # noqa: E402
from veilspark.operators.joins import join_small  # noqa: E402

_PRED_SQL = O.cascade_sql(V4_CONFIGS)
_PRED_OUT_SQL = f"SELECT *, {O.outcome_sql()} AS outcome FROM ({_PRED_SQL})"
# every model with prompt G (the v6 grid: generate and chat endpoints)
ALL_MODEL_CONFIGS = P.default_configs(P.MODELS, ["G: topic-vs-person + hard PUBLIC examples"])


def _templates_case_sql(configs, field: str) -> str:
    return "CASE config_id " + " ".join(f"WHEN {c['config_id']} THEN {O.lit(str(c[field]))}" for c in configs) + " END"


@register("outcome_tag", f"SELECT case_id, config_id, {O.outcome_sql()} AS outcome, "
                         f"{O.outcome_sql(definition='v0')} AS outcome_v0 FROM ({_PRED_SQL})")
def outcome_tag(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("case_id", "config_id", "outcome",
                    outcome(F.col("label"), F.col("predicted"), "v0").alias("outcome_v0"))


_UNDECIDED_SQL = (f"SELECT c.case_id, c.text, cfg.config_id FROM ({O.classify_select('v4', '(' + O.CASES + ')')}) c "
                  f"CROSS JOIN {O.config_values(V4_CONFIGS)} WHERE c.verdict <> 'SENSITIVE'")


@register("render_prompt",
          f"SELECT case_id, config_id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_chars FROM "
          f"(SELECT *, replace({_templates_case_sql(V4_CONFIGS, 'template')}, '{{text}}', text) AS p "
          f"FROM ({_UNDECIDED_SQL}))")
def render_prompt(spark, sf_dir):
    r = K.undecided_requests(C.classify(labelled_cases(spark, sf_dir), "v4"), V4_CONFIGS)
    return r.select("case_id", "config_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def _fewshot_prompt_sql(examples, text: str = "text", cut: int = 150) -> str:
    lines = ", ".join(O.lit(f'Message: "{t[:cut]}" -> {l}') for t, l in examples)
    return (f"array_to_string(['Examples:', {lines}, chr(10) || 'Message: \"' || {text} || '\"' || chr(10) "
            f"|| 'Classification:'], chr(10))")


@register("render_fewshot_prompt",
          f"SELECT case_id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_chars FROM "
          f"(SELECT case_id, {_fewshot_prompt_sql(P.SEED_EXAMPLES)} AS p FROM ({O.CASES}))")
def render_fewshot_prompt(spark, sf_dir):
    c = labelled_cases(spark, sf_dir)
    p = P.render_fewshot_prompt(P.examples_literal(P.SEED_EXAMPLES), F.col("text"))
    return c.select("case_id", p.alias("p")).select("case_id", F.md5("p").alias("prompt_md5"),
                                                     F.length("p").alias("prompt_chars"))


_ALL_UNDECIDED_SQL = (f"SELECT c.case_id, c.text, cfg.config_id FROM ({O.classify_select('v4', '(' + O.CASES + ')')}) c "
                      f"CROSS JOIN {O.config_values(ALL_MODEL_CONFIGS)} WHERE c.verdict <> 'SENSITIVE'")


@register("route_endpoint",
          f"SELECT case_id, config_id, CASE WHEN {_templates_case_sql(ALL_MODEL_CONFIGS, 'model')} IN "
          f"({', '.join(O.lit(m) for m in sorted(P.CHAT_MODELS))}) THEN 'chat' ELSE 'generate' END AS endpoint "
          f"FROM ({_ALL_UNDECIDED_SQL})")
def route_endpoint(spark, sf_dir):
    r = K.undecided_requests(C.classify(labelled_cases(spark, sf_dir), "v4"), ALL_MODEL_CONFIGS)
    return r.select("case_id", "config_id", P.endpoint_column(F.col("model")).alias("endpoint"))


@register("build_requests",
          f"""SELECT case_id, config_id, md5(to_json({{'model': m, 'messages': [{{'role': 'system', 'content': s}},
              {{'role': 'user', 'content': replace(t, '{{text}}', text)}}], 'stream': false,
              'options': {{'temperature': 0, 'num_predict': n}}}})) AS request_md5 FROM
              (SELECT *, {_templates_case_sql(ALL_MODEL_CONFIGS, 'model')} AS m,
                 {_templates_case_sql(ALL_MODEL_CONFIGS, 'system')} AS s,
                 {_templates_case_sql(ALL_MODEL_CONFIGS, 'template')} AS t,
                 CAST({_templates_case_sql(ALL_MODEL_CONFIGS, 'max_tokens')} AS INTEGER) AS n
               FROM ({_ALL_UNDECIDED_SQL}))""")
def build_requests(spark, sf_dir):
    r = K.undecided_requests(C.classify(labelled_cases(spark, sf_dir), "v4"), ALL_MODEL_CONFIGS)
    req = P.build_request(F.col("model"), F.col("system"), F.col("prompt"), F.col("max_tokens"))
    return r.select("case_id", "config_id", F.md5(req).alias("request_md5"))


_RAW, _ERR, _LAT = O.standin()


@register("parse_response",
          f"SELECT case_id, config_id, raw, error, {O.parse('raw', 'error')} AS parsed, "
          f"{O.parse('raw', 'error', False)} AS parsed_no_strip, "
          f"CASE WHEN {O.parse('raw', 'error')} IN ('SENSITIVE', 'PUBLIC') THEN {O.parse('raw', 'error')} "
          f"ELSE 'SENSITIVE' END AS final FROM (SELECT c.case_id, cfg.config_id, {_RAW} AS raw, {_ERR} AS error "
          f"FROM ({O.CASES}) c CROSS JOIN {O.config_values(V4_CONFIGS)})")
def parse_response(spark, sf_dir):
    rows = P.with_configs(labelled_cases(spark, sf_dir).select("case_id", "text"), V4_CONFIGS, ("config_id",))
    raw, err, _ = A.standin_answer(F.col("config_id"), F.col("text"))
    r = rows.select("case_id", "config_id", raw.alias("raw"), err.alias("error"))
    parsed = A.parse_answer(F.col("raw"), F.col("error"))
    return r.select("case_id", "config_id", "raw", "error", parsed.alias("parsed"),
                    A.parse_answer(F.col("raw"), F.col("error"), False).alias("parsed_no_strip"),
                    A.failsafe(parsed).alias("final"))


@register("score_undecided",
          f"SELECT case_id, config_id, {O.standin()[0]} AS raw, {O.standin()[1]} AS error, "
          f"{O.standin()[2]} AS latency_ms FROM ({_UNDECIDED_SQL})")
def score_undecided(spark, sf_dir):
    """D6 through the Python batch hook (mapInArrow) with the stand-in callable."""
    r = K.undecided_requests(C.classify(labelled_cases(spark, sf_dir), "v4"), V4_CONFIGS)
    return K.score_batches(r.select("case_id", "config_id", "text", "model", "endpoint", "prompt"))


from veilspark.operators import answer_store as AS  # noqa: E402
from veilspark.session import scratch_path  # noqa: E402

_FIRST_RUN = V4_CONFIGS[:3]


def two_runs(spark, sf_dir):
    """A run over half of the configurations, then one over all, with one store."""
    store, classified = scratch_path(spark, "answers"), C.classify(labelled_cases(spark, sf_dir), "v4")
    AS.ask(K.undecided_requests(classified, _FIRST_RUN), store, run="run1")
    return store, AS.ask(K.undecided_requests(classified, V4_CONFIGS), store, run="run2")


@register("score_with_store",
          f"SELECT case_id, config_id, {O.standin()[0]} AS raw, {O.standin()[1]} AS error, {O.standin()[2]} AS latency_ms, "
          f"CASE WHEN config_id <= {_FIRST_RUN[-1]['config_id']} THEN 'run1' ELSE 'run2' END AS run FROM ({_UNDECIDED_SQL})")
def score_with_store(spark, sf_dir):
    """D6/M4 with kept answers: the second run's rows, and the run that asked for each."""
    return two_runs(spark, sf_dir)[1]


@register("answer_store_asked",
          f"SELECT CASE WHEN config_id <= {_FIRST_RUN[-1]['config_id']} THEN 'run1' ELSE 'run2' END AS run, "
          f"count(*) AS n_asked FROM (SELECT DISTINCT config_id, text FROM ({_UNDECIDED_SQL})) GROUP BY 1")
def answer_store_asked(spark, sf_dir):
    """How many requests each run asked: every different one once."""
    store, _ = two_runs(spark, sf_dir)
    return AS.commits.committed(spark, store, AS.ANSWERS).groupBy("run").agg(F.count(F.lit(1)).alias("n_asked"))


@register("join_responses",
          f"SELECT case_id, config_id, label, predicted, method, latency_ms FROM ({_PRED_SQL})")
def join_responses(spark, sf_dir):
    """D6/D8 with a landed responses table: the scorer's answers are written
    to the shared checkpoint folder, then joined (LEFT) to the case rows."""
    cases = labelled_cases(spark, sf_dir)
    pred = K.cascade(cases, V4_CONFIGS, "v4", scorer=K.standin_scorer)
    return pred.select("case_id", "config_id", "label", "predicted", "method", "latency_ms")


@register("second_stage_only",
          f"SELECT case_id, config_id, label, CASE WHEN p IN ('SENSITIVE', 'PUBLIC') THEN p ELSE 'SENSITIVE' END "
          f"AS predicted, {_LAT} AS latency_ms FROM (SELECT c.*, cfg.config_id, {O.parse(_RAW, _ERR)} AS p "
          f"FROM ({O.CASES}) c CROSS JOIN {O.config_values(V4_CONFIGS)})")
def second_stage_only(spark, sf_dir):
    return K.second_stage_only(labelled_cases(spark, sf_dir), V4_CONFIGS).select(
        "case_id", "config_id", "label", "predicted", "latency_ms")


@register("route_messages",
          f"SELECT case_id, config_id, predicted, CASE WHEN predicted = 'PUBLIC' THEN 'cloud' ELSE 'local' END "
          f"AS route FROM ({_PRED_SQL})")
def route_messages(spark, sf_dir):
    return K.route(predictions(spark, sf_dir)).select("case_id", "config_id", "predicted", "route")


@register("case_config_matrix",
          f"SELECT c.case_id, cfg.config_id, c.verdict FROM ({O.classify_select('v4', '(' + O.CASES + ')')}) c "
          f"CROSS JOIN {O.config_values(V4_CONFIGS)}")
def case_config_matrix(spark, sf_dir):
    """Rules run once per case, then each case row is expanded per config."""
    c = C.classify(labelled_cases(spark, sf_dir), "v4").select("case_id", "verdict")
    return P.with_configs(c, V4_CONFIGS, ("config_id",)).select("case_id", "config_id", "verdict")


# confusion under three definitions: hybrid v4 predictions (configs 1..6) plus
# the v0 rules-only baseline (config 0), whose UNCERTAIN answers make the
# definitions differ
_V0_RULES_SQL = (f"SELECT case_id, 0 AS config_id, label, verdict AS predicted, 0.0::DOUBLE AS latency_ms "
                 f"FROM ({O.classify_select('v0', '(' + O.CASES + ')')})")
_MIXED_SQL = (f"SELECT case_id, config_id, label, predicted, latency_ms FROM ({_PRED_SQL}) "
              f"UNION ALL {_V0_RULES_SQL}")


def mixed_predictions(spark, sf_dir) -> DataFrame:
    h = predictions(spark, sf_dir).select("case_id", "config_id", "label", "predicted", "latency_ms")
    v0 = C.rules_only(labelled_cases(spark, sf_dir), "v0", uncertain_as=None).select(
        "case_id", F.lit(0).alias("config_id"), "label", "predicted", "latency_ms")
    return h.unionByName(v0)


_CONF_COLS = "config_id, total, n_sensitive, n_public, correct, false_negatives, false_positives"
for _d in ("v0", "v1", "fewshot"):
    register(f"confusion_{_d}", f"SELECT {_CONF_COLS} FROM ({O.confusion_sql(_MIXED_SQL, definition=_d)})")(
        (lambda d: lambda spark, sf_dir: E.confusion(mixed_predictions(spark, sf_dir), ("config_id",), d)
         .select(*[c.strip() for c in _CONF_COLS.split(",")]))(_d))


_METRICS_SQL = O.metrics_sql(O.confusion_sql(_PRED_SQL))


@register("latency_summary", f"SELECT config_id, llm_calls, total_latency_ms, avg_latency_ms, total_time_s "
                             f"FROM ({_METRICS_SQL})")
def latency_summary(spark, sf_dir):
    return v4_metrics(spark, sf_dir).select("config_id", "llm_calls", "total_latency_ms", "avg_latency_ms",
                                            "total_time_s")


@register("weighted_utility",
          f"""SELECT config_id, sum(u) AS utility_sum, count(*) AS n, CAST(count_if(predicted = label) AS BIGINT) AS hits,
              sum(u) / CAST(count(*) AS DOUBLE) AS weighted_utility,
              CAST(count_if(predicted = label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS plain_accuracy
              FROM (SELECT *, CASE WHEN predicted = label THEN 1.0::DOUBLE WHEN label = 'SENSITIVE' AND
                    predicted = 'PUBLIC' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END AS u FROM ({_PRED_SQL}))
              GROUP BY config_id""")
def weighted_utility(spark, sf_dir):
    return E.weighted_utility(predictions(spark, sf_dir))


@register("combined_scores",
          f"SELECT config_id, fnr_pct + fpr_pct AS score_sum, fnr_pct + fpr_pct * 0.5::DOUBLE AS score_half_fpr, "
          f"fnr_pct * 2.0::DOUBLE + fpr_pct AS score_double_fnr FROM ({_METRICS_SQL})")
def combined_scores(spark, sf_dir):
    return E.combined_scores(v4_metrics(spark, sf_dir)).select("config_id", "score_sum", "score_half_fpr",
                                                              "score_double_fnr")


@register("leak_samples",
          f"SELECT config_id, outcome, case_id, substr(text, 1, 100) AS preview, "
          f"CAST(row_number() OVER (PARTITION BY config_id, outcome ORDER BY case_id) AS INTEGER) AS pos "
          f"FROM ({_PRED_OUT_SQL}) WHERE outcome <> 'OK' QUALIFY pos <= 10")
def leak_samples(spark, sf_dir):
    return E.leak_samples(predictions(spark, sf_dir, keep_text=True), 10, 100)


@register("stage_coverage",
          f"SELECT config_id, label, count(*) AS n, CAST(count_if(starts_with(method, 'regex:')) AS BIGINT) AS rule_decided, "
          f"CAST(count_if(starts_with(method, 'regex:')) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rule_share "
          f"FROM ({_PRED_SQL}) GROUP BY config_id, label")
def stage_coverage(spark, sf_dir):
    return E.stage_coverage(predictions(spark, sf_dir))


@register("rule_hit_counts",
          f"SELECT rule, count(*) AS hits FROM (SELECT unnest(matches) AS rule FROM "
          f"({O.classify_select('v1', '(' + O.MESSAGES + ')')})) GROUP BY rule")
def rule_hit_counts(spark, sf_dir):
    return E.rule_hit_counts(C.classify(messages(spark, sf_dir), "v1"))


_LB = "config_id, accuracy_pct, fnr_pct, fpr_pct"


@register("leaderboard_accuracy",
          f"SELECT {_LB}, CAST(row_number() OVER (ORDER BY accuracy_pct DESC, fnr_pct, config_id) AS INTEGER) AS rank FROM ({_METRICS_SQL})")
def leaderboard_accuracy(spark, sf_dir):
    return E.leaderboard(v4_metrics(spark, sf_dir), "accuracy").select(*_LB.split(", "), "rank")


@register("leaderboard_fnr",
          f"SELECT {_LB}, CAST(row_number() OVER (ORDER BY fnr_pct, config_id) AS INTEGER) AS rank FROM ({_METRICS_SQL})")
def leaderboard_fnr(spark, sf_dir):
    return E.leaderboard(v4_metrics(spark, sf_dir), "fnr").select(*_LB.split(", "), "rank")


@register("leaderboard_combined",
          f"SELECT {_LB}, CAST(row_number() OVER (ORDER BY fnr_pct + fpr_pct, config_id) AS INTEGER) AS rank, "
          f"fnr_pct + fpr_pct AS score, fnr_pct < 3.0 AND fpr_pct < 15.0 AS target FROM ({_METRICS_SQL})")
def leaderboard_combined(spark, sf_dir):
    return E.leaderboard(v4_metrics(spark, sf_dir), "combined").select(*_LB.split(", "), "rank", "score", "target")


_CFG_VALUES = ("(VALUES " + ", ".join(f"({c['config_id']}, {O.lit(c['model'])}, {O.lit(c['prompt_name'])})"
                                      for c in V4_CONFIGS) + ") AS cfg(config_id, model, prompt_name)")


@register("best_config",
          f"SELECT m.config_id, cfg.model, cfg.prompt_name, m.accuracy_pct, m.fnr_pct, m.fpr_pct, m.avg_latency_ms "
          f"FROM ({_METRICS_SQL}) m JOIN {_CFG_VALUES} ON m.config_id = cfg.config_id WHERE m.fpr_pct < 20 "
          f"ORDER BY m.fnr_pct + m.fpr_pct * 0.5, m.config_id LIMIT 1")
def best_config(spark, sf_dir):
    """H6 + E6 + A8: constrained argmin, joined to its configuration by id."""
    best = E.best_config(v4_metrics(spark, sf_dir), 20.0)
    cfg = P.configs_frame(spark, V4_CONFIGS).select("config_id", "model", "prompt_name")
    return best.join(F.broadcast(cfg), "config_id").select(
        "config_id", "model", "prompt_name", "accuracy_pct", "fnr_pct", "fpr_pct", "avg_latency_ms")


_HOLD_SQL = O.split_sql(O.CASES, kind="50/50")


@register("eval_by_subset",
          f"""WITH p AS ({_PRED_SQL}), h AS (SELECT case_id, split FROM ({_HOLD_SQL})),
              m AS (SELECT p.*, 'full' AS eval_set FROM p UNION ALL
                    SELECT p.*, 'holdout' AS eval_set FROM p JOIN h ON p.case_id = h.case_id WHERE h.split = 'test'),
              mm AS (SELECT m.*, cfg.model FROM m JOIN {_CFG_VALUES} ON m.config_id = cfg.config_id)
              SELECT eval_set, model, {_METRIC_COLS} FROM ({O.metrics_sql(O.confusion_sql('SELECT * FROM mm', by='eval_set, model, config_id'))})""")
def eval_by_subset(spark, sf_dir):
    """E4 + F10: every config on the full set and on the holdout half; the
    split column rides along the cascade (no join back), memberships are
    exploded, and all subsets are kept (not only the last)."""
    cases = S.label_holdout(labelled_cases(spark, sf_dir), "case_id", 42)
    pred = K.cascade(cases, V4_CONFIGS, "v4")
    sets = F.filter(F.array(F.lit("full"), F.when(F.col("split") == "test", F.lit("holdout"))), lambda x: x.isNotNull())
    pred = pred.withColumn("eval_set", F.explode(sets))
    model = F.element_at(F.array(*[F.lit(c["model"]) for c in V4_CONFIGS]), F.col("config_id"))
    m = E.metrics(E.confusion(pred.withColumn("model", model), ("eval_set", "model", "config_id")))
    return m.select("eval_set", "model", *[c.strip() for c in _METRIC_COLS.split(",")])


from veilspark.operators import membership as MB  # noqa: E402

_SET_COLS = ("config_id, total, n_sensitive, n_public, correct, false_negatives, false_positives, llm_calls, "
             "accuracy, fnr, fpr, accuracy_pct, fnr_pct, fpr_pct")
SHORT = 300


@register("eval_by_membership",
          f"""WITH p AS ({_PRED_SQL}), h AS (SELECT case_id, split FROM ({_HOLD_SQL})), t AS (SELECT case_id, length(text) AS n FROM ({O.CASES})),
              m AS (SELECT p.*, 'full' AS eval_set FROM p UNION ALL
                    SELECT p.*, 'holdout' AS eval_set FROM p JOIN h ON p.case_id = h.case_id WHERE h.split = 'test' UNION ALL
                    SELECT p.*, 'short' AS eval_set FROM p JOIN t ON p.case_id = t.case_id WHERE t.n <= {SHORT})
              SELECT eval_set, {_SET_COLS} FROM ({O.metrics_sql(O.confusion_sql('SELECT * FROM m', by='eval_set, config_id'))})""")
def eval_by_membership(spark, sf_dir):
    """E4 + F10 from kept bitmaps: the cascade runs once; the full set, the
    holdout and a set of short cases named afterwards are intersected with it."""
    cells = K.land(MB.outcome_cells(predictions(spark, sf_dir)), "outcome-cells")
    cases = labelled_cases(spark, sf_dir)
    held = S.label_holdout(cases.select("case_id"), "case_id", 42)
    names = F.array_compact(F.array(F.lit("full"), F.when(F.col("split") == "test", F.lit("holdout"))))
    sets = K.land(MB.bitmaps(held.select("case_id", F.explode(names).alias("eval_set")), ["eval_set"]), "eval-sets")
    added = MB.bitmaps(cases.where(F.length("text") <= SHORT).select("case_id", F.lit("short").alias("eval_set")), ["eval_set"])
    m = MB.set_metrics(cells, sets.unionByName(added))
    return m.select("eval_set", *[c.strip() for c in _SET_COLS.split(",")])


@register("best_config_unconstrained",
          f"SELECT m.config_id, cfg.model, cfg.prompt_name, m.accuracy_pct, m.fnr_pct, m.fpr_pct, m.avg_latency_ms "
          f"FROM ({_METRICS_SQL}) m JOIN {_CFG_VALUES} ON m.config_id = cfg.config_id "
          f"ORDER BY m.fnr_pct + m.fpr_pct * 0.5, m.config_id LIMIT 1")
def best_config_unconstrained(spark, sf_dir):
    """H6 variant without the FPR constraint (min fnr + 0.5 fpr over all runs)."""
    best = E.best_config(v4_metrics(spark, sf_dir), None)
    cfg = P.configs_frame(spark, V4_CONFIGS).select("config_id", "model", "prompt_name")
    return best.join(F.broadcast(cfg), "config_id").select(
        "config_id", "model", "prompt_name", "accuracy_pct", "fnr_pct", "fpr_pct", "avg_latency_ms")


# ------------------------------------------------------------ K: few-shot
from veilspark.operators import fewshot as FS  # noqa: E402

_FS_SPLIT_SQL = O.split_sql(O.CASES)
_FS_TRAIN_SQL = f"SELECT case_id, text, label FROM ({_FS_SPLIT_SQL}) WHERE split = 'train'"


def fewshot_cases(spark, sf_dir) -> DataFrame:
    """Labelled cases with the exact 60/20/20 split."""
    return S.label_train_dev_test(labelled_cases(spark, sf_dir), "case_id", FS.SEED)


def _fs_train(spark, sf_dir):
    return fewshot_cases(spark, sf_dir).where(F.col("split") == "train").select("case_id", "text", "label")


def _candidates_sql(incumbent, rnd: int, seed: int = FS.SEED) -> str:
    """Round-``rnd`` candidates in SQL: each replacement is the train row of
    the wanted label with the smallest md5(seed|round|move|j|id)."""
    parts = []
    for m in FS.candidate_moves(incumbent, rnd, seed):
        h = f"md5(concat_ws('|', '{seed}', '{rnd}', {O.lit(m['move'])}, '{m['j']}', CAST(case_id AS VARCHAR)))"
        repl = (f"(SELECT text FROM ({_FS_TRAIN_SQL}) WHERE label = {O.lit(m['label'])} "
                f"ORDER BY {h}, case_id LIMIT 1)")
        ex = list(incumbent) + ([None] if m["move"].startswith("add") else [])
        for i, e in enumerate(ex):
            if i == m["pos"]:
                parts.append(f"SELECT {m['slot']} AS cand_id, {O.lit(m['move'])} AS move, {i} AS pos, "
                             f"{repl} AS text, {O.lit(m['label'])} AS label")
            else:
                parts.append(f"SELECT {m['slot']} AS cand_id, {O.lit(m['move'])} AS move, {i} AS pos, "
                             f"{O.lit(e[0])} AS text, {O.lit(e[1])} AS label")
    return " UNION ALL ".join(parts)


@register("fewshot_candidates",
          f"SELECT cand_id, move, pos, label, md5(text) AS text_md5 FROM ({_candidates_sql(P.SEED_EXAMPLES, 1)})")
def fewshot_candidates(spark, sf_dir):
    c = FS.candidates(spark, _fs_train(spark, sf_dir), P.SEED_EXAMPLES, 1)
    return c.select("cand_id", "move", "pos", "label", F.md5("text").alias("text_md5"))


def _standin_score_sql(cases_sql: str, cands_sql: str) -> str:
    rule = (f"(NOT {O.any_rx('text', ('guard_narrow',))} AND "
            f"{O.any_rx('text', [k for _, k in O.R.RULE_SETS['v4'].tiers[0]], False)})")
    return f"""
    WITH c AS (SELECT case_id, label, {rule} AS rule_hit, {O.word_set_sql('text')} AS cw FROM ({cases_sql})),
    e AS (SELECT cand_id, pos, label AS ex_label, {O.word_set_sql('substr(text, 1, 150)')} AS ew FROM ({cands_sql})),
    j AS (SELECT c.case_id, e.cand_id, e.ex_label,
                 CAST(len(list_intersect(cw, ew)) AS DOUBLE) /
                 CAST(len(cw) + len(ew) - len(list_intersect(cw, ew)) AS DOUBLE) AS jac
          FROM c CROSS JOIN e WHERE NOT c.rule_hit),
    b AS (SELECT case_id, cand_id, max(jac) AS mj,
                 bool_or(ex_label = 'SENSITIVE' AND jac = mx) AS s
          FROM (SELECT *, max(jac) OVER (PARTITION BY case_id, cand_id) AS mx FROM j) GROUP BY case_id, cand_id),
    g AS (SELECT c.case_id, c.label, c.rule_hit, ids.cand_id FROM c CROSS JOIN (SELECT DISTINCT cand_id FROM e) ids),
    p AS (SELECT g.case_id, g.cand_id, g.label,
                 CASE WHEN g.rule_hit THEN 'SENSITIVE' WHEN b.mj IS NULL OR b.mj <= 0 OR b.s THEN 'SENSITIVE'
                      ELSE 'PUBLIC' END AS predicted, 0.0::DOUBLE AS latency_ms
          FROM g LEFT JOIN b ON g.case_id = b.case_id AND g.cand_id = b.cand_id)
    SELECT cand_id, total, correct, false_negatives, false_positives, accuracy_pct, fnr_pct, fpr_pct,
           fnr_pct * 2.0::DOUBLE + fpr_pct AS score
    FROM ({O.metrics_sql(O.confusion_sql('SELECT * FROM p', by='cand_id', definition='fewshot'))})"""


def _seed_cands_sql(examples, cand_id: int) -> str:
    return " UNION ALL ".join(f"SELECT {cand_id} AS cand_id, {i} AS pos, {O.lit(t)} AS text, {O.lit(l)} AS label"
                              for i, (t, l) in enumerate(examples))


_FS_DEV_SAMPLE_SQL = (f"SELECT case_id, text, label FROM ({_FS_SPLIT_SQL}) WHERE split = 'dev' "
                      f"ORDER BY {O.seeded_hash_sql('case_id', FS.SEED, 1)}, case_id LIMIT 100")


@register("fewshot_round",
          _standin_score_sql(_FS_DEV_SAMPLE_SQL,
                             f"SELECT cand_id, pos, text, label FROM ({_candidates_sql(P.SEED_EXAMPLES, 1)}) "
                             f"UNION ALL {_seed_cands_sql(P.SEED_EXAMPLES, -1)}"))
def fewshot_round(spark, sf_dir):
    """K2: round 1 -- every candidate and the incumbent (cand_id -1) scored on
    the same seeded 100-case dev sample."""
    cases = fewshot_cases(spark, sf_dir)
    train = cases.where(F.col("split") == "train").select("case_id", "text", "label")
    dev = cases.where(F.col("split") == "dev").select("case_id", "text", "label")
    lists = FS.lists_of(FS.candidate_rows(P.SEED_EXAMPLES, 1, FS.draw_replacements(train, [1])))
    sample = S.seeded_sample(dev, 100, "case_id", FS.SEED, 1)
    return FS.score(FS.standin_predict(sample, lists | {-1: P.SEED_EXAMPLES}))


@register("fewshot_test_score",
          _standin_score_sql(f"SELECT case_id, text, label FROM ({_FS_SPLIT_SQL}) WHERE split = 'test'",
                             _seed_cands_sql(P.SEED_EXAMPLES, 0)))
def fewshot_test_score(spark, sf_dir):
    """K4: an example list (here the seed) scored on the held-out test split."""
    test = fewshot_cases(spark, sf_dir).where(F.col("split") == "test")
    return FS.score(FS.standin_predict(test, {0: P.SEED_EXAMPLES}))


def search_rows(spark, sf_dir, rounds: int) -> DataFrame:
    ex, dev, test = FS.search(spark, fewshot_cases(spark, sf_dir), P.SEED_EXAMPLES, rounds=rounds)
    rows = [(i, t, l, float(dev["score"]), float(test["score"]), float(test["fnr_pct"]), float(test["fpr_pct"]))
            for i, (t, l) in enumerate(ex)]
    return spark.createDataFrame(rows, "pos int, text string, label string, dev_score double, test_score double, "
                                       "test_fnr_pct double, test_fpr_pct double")


_FS_ROUND1_SQL = _candidates_sql(P.SEED_EXAMPLES, 1)
_FS_LISTS_SQL = (f"SELECT cand_id, pos, text, label FROM ({_FS_ROUND1_SQL}) "
                 f"UNION ALL {_seed_cands_sql(P.SEED_EXAMPLES, -1)}")


def _fs_split_sql(split: str) -> str:
    return f"SELECT case_id, text, label FROM ({_FS_SPLIT_SQL}) WHERE split = '{split}'"


@register("fewshot_search_one",
          f"""WITH lists AS MATERIALIZED ({_FS_LISTS_SQL}),
              quick AS MATERIALIZED ({_standin_score_sql(_FS_DEV_SAMPLE_SQL, 'SELECT * FROM lists')}),
              dev AS MATERIALIZED ({_standin_score_sql(_fs_split_sql('dev'), 'SELECT * FROM lists')}),
              test AS MATERIALIZED ({_standin_score_sql(_fs_split_sql('test'), 'SELECT * FROM lists')}),
              winner AS (SELECT cand_id FROM quick WHERE cand_id >= 0 AND score < (SELECT score FROM quick WHERE cand_id = -1)
                         ORDER BY score, cand_id LIMIT 1),
              taken AS (SELECT coalesce((SELECT w.cand_id FROM winner w JOIN dev d ON w.cand_id = d.cand_id
                                         WHERE d.score < (SELECT score FROM dev WHERE cand_id = -1)), -1) AS cand_id)
              SELECT l.pos, l.text, l.label, dev.score AS dev_score, test.score AS test_score,
                     test.fnr_pct AS test_fnr_pct, test.fpr_pct AS test_fpr_pct
              FROM taken t JOIN lists l ON l.cand_id = t.cand_id JOIN dev ON dev.cand_id = t.cand_id
              JOIN test ON test.cand_id = t.cand_id""")
def fewshot_search_one(spark, sf_dir):
    """K3 with one round: propose, score on the sample, verify on all of dev,
    accept if better; the list and its scores."""
    return search_rows(spark, sf_dir, 1)


@register("fewshot_search")
def fewshot_search(spark, sf_dir):
    """K3: 12 rounds of hill climbing; returns the final example list with its
    dev and test scores (iterative: rows-only check; the tests hold it against
    a plain twin)."""
    return search_rows(spark, sf_dir, 12)


# ----------------------------------------------------- L: streaming, X1
from veilspark.operators.leakage import contained_passages  # noqa: E402
from veilspark.streaming import stream as ST  # noqa: E402


@register("stream_classify",
          f"SELECT doc_id, verdict, array_to_string(matches, ',') AS matches FROM "
          f"({O.classify_select('v4', '(SELECT doc_id, text FROM documents)')})")
def stream_classify(spark, sf_dir):
    return ST.stream_classify(spark, sf_dir).select("doc_id", "verdict", "matches")


_WINNER = ST.winner_config()


@register("stream_route",
          f"SELECT case_id, predicted, method, CASE WHEN predicted = 'PUBLIC' THEN 'cloud' ELSE 'local' END AS route "
          f"FROM ({O.cascade_sql([_WINNER], cases='SELECT doc_id AS case_id, text, CAST(NULL AS VARCHAR) AS label FROM documents')})")
def stream_route(spark, sf_dir):
    return ST.stream_route(spark, sf_dir, _WINNER).select("case_id", "predicted", "method", "route")


@register("stream_dedup",
          "SELECT DISTINCT md5(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)) AS fp FROM events")
def stream_dedup(spark, sf_dir):
    """All repeats lie within the delay asked for, so each row has a fingerprint of its own."""
    return ST.stream_dedup(spark, sf_dir, "10000 days").select("fp")


_DEDUP_DAYS = 1


@register("stream_dedup_expiring",
          f"""WITH RECURSIVE e AS (SELECT event_id, ts, md5(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)) AS fp FROM events),
              kept AS (
                SELECT fp, min(ts) AS ts FROM e GROUP BY fp
                UNION ALL
                SELECT fp, ts FROM (SELECT k.fp, min(e.ts) AS ts FROM kept k JOIN e ON e.fp = k.fp AND e.ts > k.ts + INTERVAL {_DEDUP_DAYS} DAY GROUP BY k.fp))
              SELECT min(event_id) AS event_id, fp FROM kept JOIN e USING (fp, ts) GROUP BY fp, ts""")
def stream_dedup_expiring(spark, sf_dir):
    """L3 with expiry: a repeat counts again when the kept one is over a day old."""
    return ST.stream_dedup_expiring(spark, sf_dir, _DEDUP_DAYS * 86400).select("event_id", "fp")


@register("stream_window_counts",
          "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, "
          "count(*) AS n FROM events GROUP BY time_bucket(INTERVAL '1 day', ts), event_type")
def stream_window_counts(spark, sf_dir):
    return ST.stream_window_counts(spark, sf_dir)


@register("exemplar_leakage",
          "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def exemplar_leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    items = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return contained_passages(docs, items, "doc_id", "item_id")


# ----------------------------------------------------------- A6/A7: sinks
from veilspark.sources import sinks as SK  # noqa: E402


@register("write_corpus_roundtrip",
          f"SELECT case_id, label, source, split FROM ({O.split_sql(O.corpus_sql())})")
def write_corpus_roundtrip(spark, sf_dir):
    """Corpus with its split written as parquet partitioned by split to
    the shared folder, then read back."""
    corpus = S.split_train_dev_test(CO.build_corpus(spark, sf_dir), "case_id", 42)
    back = SK.write_corpus(corpus.select("case_id", "text", "label", "source", "source_rank", "lang", "split"))
    return back.select("case_id", "label", "source", "split")


_MISSES_SQL = (f"SELECT config_id, outcome, case_id, substr(text, 1, 100) AS preview, method "
               f"FROM ({_PRED_OUT_SQL}) WHERE outcome <> 'OK'")


@register("all_misses", _MISSES_SQL)
def all_misses(spark, sf_dir):
    """F7, the whole form: every leak and false alarm with the method that made it."""
    return E.misses(predictions(spark, sf_dir, keep_text=True), 100)


@register("write_results",
          f"SELECT {', '.join('m.' + c.strip() for c in _METRIC_COLS.split(','))}, outcome, case_id, preview, method "
          f"FROM ({_METRICS_SQL}) m LEFT JOIN ({_MISSES_SQL}) s ON m.config_id = s.config_id")
def write_results(spark, sf_dir):
    """The full record (metrics, and every miss as a row of a table beside
    them) written and read back; predictions are landed once for both."""
    pred = K.land(predictions(spark, sf_dir, keep_text=True), "predictions")
    metrics, misses = SK.write_results(E.metrics(E.confusion(pred)), E.misses(pred, 100))
    return metrics.select(*[c.strip() for c in _METRIC_COLS.split(",")]).join(misses, "config_id", "left")


# ------------------------------------- rules on probe text: every rule can hit
for _rs in ("v0", "v1", "v2", "v3", "v4"):
    register(f"classify_probe_{_rs}",
             f"SELECT doc_id, verdict, array_to_string(matches, ',') AS matches "
             f"FROM ({O.classify_select(_rs, '(' + PROBE_DOCS_SQL + ')')})")(
        (lambda rs: lambda spark, sf_dir: C.classify(probe_documents(spark, sf_dir), rs).select(
            "doc_id", "verdict", F.array_join("matches", ",").alias("matches")))(_rs))
    register(f"rule_hit_counts_{_rs}",
             f"SELECT rule, count(*) AS hits FROM (SELECT unnest(matches) AS rule FROM "
             f"({O.classify_select(_rs, '(' + PROBE_DOCS_SQL + ')')})) GROUP BY rule")(
        (lambda rs: lambda spark, sf_dir: E.rule_hit_counts(C.classify(probe_documents(spark, sf_dir), rs)))(_rs))


_EVENT_PROBE_SQL = f"SELECT ts, {probe_text_sql('props', 'event_id')} AS text FROM events"


@register("stream_verdict_counts",
          f"""WITH c AS ({O.classify_select('v4', '(' + _EVENT_PROBE_SQL + ')')}),
              k AS (SELECT ts, 'verdict:' || verdict AS kind FROM c
                    UNION ALL SELECT ts, 'rule:' || unnest(matches) AS kind FROM c)
              SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, kind, count(*) AS n
              FROM k GROUP BY time_bucket(INTERVAL '1 day', ts), kind""")
def stream_verdict_counts(spark, sf_dir):
    """L4: verdicts and rule hits per day over the events' properties as messages."""
    events = ST.event_time(ST.read_stream(spark, sf_dir, "events"))
    return ST.stream_verdict_counts(events.select("ts", probe_text("props", "event_id").alias("text")))


# ----------------------- metrics as parameters, tables of configurations, A4/A8
_UTILITY = ("CASE WHEN a = label THEN 1.0::DOUBLE WHEN label = 'SENSITIVE' AND a = 'PUBLIC' THEN {leak}::DOUBLE "
            "ELSE {alarm}::DOUBLE END")
_NORMAL_SQL = ("CASE WHEN contains(upper(trim(coalesce(raw, ''))), 'SENSITIVE') THEN 'SENSITIVE' "
               "WHEN contains(upper(trim(coalesce(raw, ''))), 'PUBLIC') THEN 'PUBLIC' ELSE 'SENSITIVE' END")


@register("utility_by_metric",
          f"""SELECT config_id, count(*) AS n,
              sum({_UTILITY.format(leak='-2.0', alarm='0.0')}) / CAST(count(*) AS DOUBLE) AS leaks_weigh_two,
              sum({_UTILITY.format(leak='-1.0', alarm='-0.5')}) / CAST(count(*) AS DOUBLE) AS alarms_cost_too
              FROM (SELECT config_id, label, {_NORMAL_SQL} AS a FROM
                    (SELECT c.label, cfg.config_id, {_RAW} AS raw FROM ({O.CASES}) c CROSS JOIN {O.config_values(V4_CONFIGS)}))
              GROUP BY config_id""")
def utility_by_metric(spark, sf_dir):
    """M3 + B14: two metrics over raw scorer answers, normalised on the way."""
    rows = P.with_configs(labelled_cases(spark, sf_dir).select("text", "label"), V4_CONFIGS, ("config_id",))
    raw = A.standin_answer(F.col("config_id"), F.col("text"))[0]
    rows = rows.select("config_id", "label", raw.alias("raw"))
    label, answer = F.col("label"), F.col("raw")
    return E.mean_utility(rows, {"leaks_weigh_two": E.outcome_utility(label, answer),
                                 "alarms_cost_too": E.outcome_utility(label, answer, 1.0, -1.0, -0.5)})


WHOLE_GRID = P.default_configs(P.MODELS, [p["prompt_name"] for p in P.PROMPTS])
_WHOLE_METRICS_SQL = O.metrics_sql(O.confusion_sql(O.cascade_sql(WHOLE_GRID)))


@register("metrics_of_configs_table", f"SELECT {_METRIC_COLS} FROM ({_WHOLE_METRICS_SQL})")
def metrics_of_configs_table(spark, sf_dir):
    """Every model with every prompt, the reframed one without its examples
    too, as a table of configurations that the run reads."""
    grid = K.land(P.configs_frame(spark, WHOLE_GRID).select("config_id", "model", "prompt_name", "system", "template"), "configs")
    pred = predictions(spark, sf_dir, configs=P.configs_of(grid))
    return E.metrics(E.confusion(pred)).select(*[c.strip() for c in _METRIC_COLS.split(",")])


@register("write_best_config",
          f"SELECT m.config_id, cfg.model, cfg.prompt_name, {_templates_case_sql(V4_CONFIGS, 'system').replace('config_id', 'm.config_id')} AS system, "
          f"{_templates_case_sql(V4_CONFIGS, 'template').replace('config_id', 'm.config_id')} AS template, m.accuracy_pct, m.fnr_pct, m.fpr_pct, m.avg_latency_ms "
          f"FROM (SELECT *, avg(fpr_pct) OVER () AS mean_fpr FROM ({_METRICS_SQL})) m "
          f"JOIN {_CFG_VALUES} ON m.config_id = cfg.config_id WHERE m.fpr_pct < m.mean_fpr "
          f"ORDER BY m.fnr_pct + m.fpr_pct * 0.5, m.config_id LIMIT 1")
def write_best_config(spark, sf_dir):
    """A8 + H6: the best of the configurations with fewer false alarms than the
    mean (a bound that some meet and some do not), written and read back."""
    from pyspark.sql import Window
    mean = F.avg("fpr_pct").over(Window.partitionBy())  # one row a configuration
    best = E.best_config(v4_metrics(spark, sf_dir), mean)
    cfg = P.configs_frame(spark, V4_CONFIGS).select("config_id", "model", "prompt_name", "system", "template")
    return SK.write_best_config(best.join(F.broadcast(cfg), "config_id").select(
        "config_id", "model", "prompt_name", "system", "template", "accuracy_pct", "fnr_pct", "fpr_pct", "avg_latency_ms"))


@register("collect_columns",
          f"""SELECT doc_id, {O.clean_sql('text')} AS text, 'PUBLIC' AS label FROM
              (SELECT doc_id, text FROM documents WHERE lang = 'en' AND length(text) BETWEEN 25 AND 500
               QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)
              ORDER BY doc_id LIMIT 60""")
def collect_columns(spark, sf_dir):
    """C7 over a DataFrame and Columns."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return CO.collect(d, ["doc_id"], F.col("text"), "PUBLIC", 60, F.col("lang") == "en")


from dataclasses import replace as _with  # noqa: E402

STATUS_SOURCES = [*SOURCES, _with(SOURCES[3], name="legal_elsewhere", table="legal_posts", other_tables=("posts", "documents")),
                  _with(SOURCES[3], name="legal_nowhere", table="legal_posts"),
                  _with(SOURCES[3], name="legal_none", where_sql="source = 'none'")]


def _status_sql() -> str:
    parts = []
    for sp in STATUS_SOURCES:
        if sp.name == "legal_nowhere":
            parts.append(f"SELECT '{sp.name}' AS source, CAST(NULL AS VARCHAR) AS table_read, 'missing' AS status, 0::BIGINT AS n_rows")
            continue
        read = sp.other_tables[-1] if sp.other_tables else sp.table
        ok = "fallback" if sp.other_tables else "ok"
        parts.append(f"SELECT '{sp.name}' AS source, '{read}' AS table_read, "
                     f"CASE WHEN count(*) > 0 THEN '{ok}' ELSE 'empty' END AS status, count(*) AS n_rows "
                     f"FROM ({O.spec_rows_sql(_with(sp, table=read))})")
    return " UNION ALL ".join(parts)


@register("source_status", _status_sql())
def source_status(spark, sf_dir):
    """A4 + M5: what every source read, with a source whose table is missing,
    one read from another table, and one without rows."""
    from veilspark.sources.registry import source_status as status_of
    return status_of(spark, sf_dir, STATUS_SOURCES)


# the alternative of the stories: no upper length, cleaned texts cut instead
OWN_RULES = _with(SOURCES[2], max_len=None, cut=500)
WITH_OWN_RULES = [*SOURCES[:2], _with(SOURCES[2], table="stories", other_tables=("story_posts", OWN_RULES)), *SOURCES[3:]]


@register("union_sources_own_rules",
          f"SELECT case_id, text, label, source, source_rank, lang FROM ({O.union_sources_sql([*SOURCES[:2], OWN_RULES, *SOURCES[3:]])})")
def union_sources_own_rules(spark, sf_dir):
    """A4: the first tables of one source are missing; it is read by an
    alternative with its own length band and cut."""
    return CO.union_sources(spark, sf_dir, WITH_OWN_RULES).select("case_id", "text", "label", "source", "source_rank", "lang")


@register("build_corpus_labelled", f"SELECT case_id, label, source, lang, fp FROM ({O.corpus_sql(labelled=O.CASES)})")
def build_corpus_labelled(spark, sf_dir):
    """A5 + J8: the ten sources, then the labelled cases."""
    corpus = CO.build_corpus(spark, sf_dir, labelled=labelled_cases(spark, sf_dir))
    return corpus.select("case_id", "label", "source", "lang", "fp")


@register("write_routed", f"SELECT case_id, predicted, CASE WHEN predicted = 'PUBLIC' THEN 'cloud' ELSE 'local' END AS route "
                          f"FROM ({O.cascade_sql([_WINNER])})")
def write_routed(spark, sf_dir):
    """Batch routing, written by route and read back."""
    return SK.write_routed(K.route(predictions(spark, sf_dir, configs=[_WINNER])).select("case_id", "predicted", "route"))


@register("fewshot_balanced_score",
          _standin_score_sql(_fs_split_sql("test"), _seed_cands_sql(P.SEED_DEMOS_BALANCED, 0)))
def fewshot_balanced_score(spark, sf_dir):
    """K5: the balanced starting examples on the held-out test split."""
    test = fewshot_cases(spark, sf_dir).where(F.col("split") == "test")
    return FS.score(FS.standin_predict(test, {0: P.SEED_DEMOS_BALANCED}))
