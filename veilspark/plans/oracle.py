"""DuckDB twins of the registered queries (the correctness oracle).

The SQL is generated from the same rule tables and constants the Spark side
uses, so a pattern or constant lives in one place. Dialect notes: RE2 has no
``(?U)`` (it would mean "ungreedy"), so patterns go in bare with the ``'i'``
option where the rule ignores case; ``regexp_replace`` needs ``'g'``; lambdas
use the ``lambda x:`` form.
"""

from __future__ import annotations

from veilspark.functions import answers as A
from veilspark.functions import rules as R
from veilspark.functions import text as TX


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(text: str, key: str, ic: bool) -> str:
    opt = ", 'i'" if ic else ""
    return f"coalesce(regexp_matches({text}, {lit(R.PATTERNS[key])}{opt}), false)"


def any_rx(text: str, keys, ic: bool = True) -> str:
    return "(" + " OR ".join(rx(text, k, ic) for k in keys) + ")" if keys else "false"


def names(text: str, rules, ic: bool) -> str:
    items = ", ".join(f"CASE WHEN {rx(text, k, ic)} THEN {lit(n)} END" for n, k in rules)
    return f"list_filter([{items}]::VARCHAR[], lambda x: x IS NOT NULL)"


def classify_select(rule_set: str, src: str, text: str = "text") -> str:
    """SELECT adding ``matches`` (list) and ``verdict`` to every row of src."""
    rs = R.RULE_SETS[rule_set]
    if rs.mode == "plain":
        return (f"SELECT *, CASE WHEN len(matches) > 0 THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS verdict FROM "
                f"(SELECT *, {names(text, rs.tiers[0], rs.ignore_case)} AS matches FROM {src})")
    if rs.mode == "guard_first":
        g = any_rx(text, rs.guards, True)
        return (f"SELECT *, CASE WHEN len(matches) > 0 THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS verdict FROM "
                f"(SELECT *, CASE WHEN {g} THEN []::VARCHAR[] ELSE {names(text, rs.tiers[0], rs.ignore_case)} END "
                f"AS matches FROM {src})")
    g = any_rx(text, rs.guards, True)
    inner = (f"SELECT *, {g} AS _code, {names(text, rs.tiers[0], rs.ignore_case)} AS _m1, "
             f"{names(text, rs.tiers[1], rs.ignore_case)} AS _m2 FROM {src}")
    mid = f"SELECT *, CASE WHEN len(_m1) > 0 THEN _m1 ELSE _m2 END AS _m FROM ({inner})"
    return (f"SELECT * EXCLUDE (_code, _m1, _m2, _m), "
            f"CASE WHEN len(_m) > 0 AND _code THEN list_append(_m, 'code_context') ELSE _m END AS matches, "
            f"CASE WHEN len(_m) > 0 AND NOT _code THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS verdict FROM ({mid})")


def hexint(h: str, start: int, n: int) -> str:
    return f"CAST(('0x' || substr({h}, {start}, {n})) AS INTEGER)"


def standin(config_id: str = "config_id", text: str = "text") -> tuple[str, str, str]:
    """(raw, error, latency_ms) SQL of the deterministic stand-in answer."""
    h = f"md5(concat_ws('|', CAST({config_id} AS VARCHAR), coalesce({text}, '')))"
    k = f"({hexint(h, 1, 2)} % 20)"
    err = f"({hexint(h, 3, 2)} % 25 = 0)"
    whens = " ".join(f"WHEN {k} < {b} THEN {lit(a)}" for b, a in A.STANDIN_ANSWERS)
    raw = f"CASE WHEN {err} THEN NULL {whens} END"
    error = f"CASE WHEN {err} THEN {lit(A.STANDIN_ERROR)} END"
    lat = f"CAST(120 + {hexint(h, 5, 3)} % 400 AS DOUBLE)"
    return raw, error, lat


def parse(raw: str, error: str, strip_think: bool = True) -> str:
    body = f"upper(regexp_replace({raw}, {lit(A.THINK_PATTERN)}, '', 'g'))" if strip_think else f"upper({raw})"
    return (f"CASE WHEN {error} IS NOT NULL THEN 'ERROR:' || {error} "
            f"WHEN contains({body}, 'SENSITIVE') THEN 'SENSITIVE' "
            f"WHEN contains({body}, 'PUBLIC') THEN 'PUBLIC' ELSE 'UNCERTAIN' END")


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {lit(TX.STRIP_PATTERN)}, '', 'g')"


def clean_sql(text: str, n: int = TX.CLEAN_MAX_CHARS) -> str:
    return f"substr(regexp_replace({strip_sql(text)}, {lit(TX.COLLAPSE_PATTERN)}, ' ', 'g'), 1, {n})"


def word_set_sql(text: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({text}), {lit(TX.TOKEN_SPLIT)}), "
            f"lambda t: t <> ''))")


CASES = ("SELECT d.doc_id AS case_id, d.text, CASE WHEN l.toxic = 1 THEN 'SENSITIVE' ELSE 'PUBLIC' END AS label, "
         "d.source, TRY_CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INTEGER) AS source_rank, d.lang "
         "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

MESSAGES = ("SELECT 'doc' AS kind, doc_id AS msg_id, text FROM documents "
            "UNION ALL SELECT 'page' AS kind, page_id AS msg_id, html AS text FROM pages")


def config_values(configs: list[dict]) -> str:
    return "(VALUES " + ", ".join(f"({c['config_id']})" for c in configs) + ") AS cfg(config_id)"


def cascade_sql(configs: list[dict], rule_set: str = "v4", cases: str = CASES, strip_think: bool = True,
                extra: str = "") -> str:
    """Per (case, config) predictions: case_id, config_id, label, predicted,
    method, latency_ms (+ ``extra`` passthrough columns of cases)."""
    raw, err, lat = standin()
    cls = classify_select(rule_set, f"({cases})")
    ex = (", " + extra) if extra else ""
    return f"""
    WITH cls AS ({cls}),
    rows AS (SELECT c.*, cfg.config_id FROM cls c CROSS JOIN {config_values(configs)}),
    ans AS (SELECT *, CASE WHEN verdict <> 'SENSITIVE' THEN {raw} END AS raw,
                   CASE WHEN verdict <> 'SENSITIVE' THEN {err} END AS error,
                   CASE WHEN verdict <> 'SENSITIVE' THEN {lat} END AS lat FROM rows),
    prs AS (SELECT *, CASE WHEN verdict <> 'SENSITIVE' AND (raw IS NOT NULL OR error IS NOT NULL)
                           THEN {parse('raw', 'error', strip_think)} END AS parsed FROM ans)
    SELECT case_id, config_id, label{ex},
      CASE WHEN verdict = 'SENSITIVE' THEN 'SENSITIVE' WHEN parsed IN ('SENSITIVE', 'PUBLIC') THEN parsed
           ELSE 'SENSITIVE' END AS predicted,
      CASE WHEN verdict = 'SENSITIVE' THEN 'regex:' || array_to_string(matches, ',')
           WHEN parsed IN ('SENSITIVE', 'PUBLIC') THEN 'llm:' || lower(parsed) ELSE 'failsafe' END AS method,
      CASE WHEN verdict = 'SENSITIVE' THEN 0.0::DOUBLE ELSE coalesce(lat, 0.0::DOUBLE) END AS latency_ms,
      parsed, verdict, matches, text
    FROM prs"""


def outcome_sql(label: str = "label", predicted: str = "predicted", definition: str = "v1") -> str:
    if definition == "v0":
        return (f"CASE WHEN {predicted} = {label} THEN 'OK' WHEN {label} = 'SENSITIVE' THEN 'LEAK' "
                f"ELSE 'MISS' END")
    return (f"CASE WHEN {predicted} = {label} THEN 'OK' WHEN {label} = 'SENSITIVE' AND {predicted} = 'PUBLIC' "
            f"THEN 'LEAK' ELSE 'FP' END")


def confusion_sql(pred: str, by: str = "config_id", definition: str = "v1") -> str:
    ok = "predicted = label"
    if definition == "v1":
        fn = "(label = 'SENSITIVE' AND predicted = 'PUBLIC')"
        fp = f"(NOT ({ok}) AND NOT {fn})"
    elif definition == "v0":
        fn = "(label = 'SENSITIVE' AND predicted = 'PUBLIC')"
        fp = "(label = 'PUBLIC' AND predicted = 'SENSITIVE')"
    else:
        fn = f"(NOT ({ok}) AND label = 'SENSITIVE')"
        fp = f"(NOT ({ok}) AND label <> 'SENSITIVE')"
    return f"""SELECT {by}, count(*) AS total,
      {cnt("label = 'SENSITIVE'")} AS n_sensitive, {cnt("label = 'PUBLIC'")} AS n_public,
      {cnt(ok)} AS correct, {cnt(fn)} AS false_negatives, {cnt(fp)} AS false_positives,
      {cnt('coalesce(latency_ms, 0) > 0')} AS llm_calls, sum(coalesce(latency_ms, 0.0)) AS total_latency_ms
    FROM ({pred}) GROUP BY {by}"""


def cnt(cond: str) -> str:
    """count_if typed like Spark's (bigint; DuckDB would give HUGEINT)."""
    return f"CAST(count_if({cond}) AS BIGINT)"


def rate_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) * 100.0::DOUBLE / CAST({den} AS DOUBLE) ELSE 0.0::DOUBLE END"


def pct_sql(num: str, den: str) -> str:
    return (f"CASE WHEN {den} > 0 THEN CAST(({num} * 2000 + {den}) // ({den} * 2) AS DOUBLE) / 10.0::DOUBLE "
            f"ELSE 0.0::DOUBLE END")


def metrics_sql(conf: str) -> str:
    return f"""SELECT *,
      {rate_sql('correct', 'total')} AS accuracy, {rate_sql('false_negatives', 'n_sensitive')} AS fnr,
      {rate_sql('false_positives', 'n_public')} AS fpr,
      {pct_sql('correct', 'total')} AS accuracy_pct, {pct_sql('false_negatives', 'n_sensitive')} AS fnr_pct,
      {pct_sql('false_positives', 'n_public')} AS fpr_pct,
      CASE WHEN llm_calls > 0 THEN total_latency_ms / CAST(llm_calls AS DOUBLE) ELSE 0.0::DOUBLE END AS avg_latency_ms,
      total_latency_ms / 1000.0::DOUBLE AS total_time_s
    FROM ({conf})"""


# ------------------------------------------------------------------ corpus
def spec_rows_sql(spec) -> str:
    if spec.first_human:
        return (f"SELECT CAST(conv_id AS BIGINT) AS local_id, 0::BIGINT AS local_turn, arg_min(text, turn) AS raw, "
                f"CAST(NULL AS VARCHAR) AS lang FROM conversations WHERE role = {lit(spec.human_role)} GROUP BY conv_id")
    conds = [c for c in (spec.where_sql, f"role = {lit(spec.human_role)}" if spec.human_role else None) if c]
    where = (" WHERE " + " AND ".join(f"({c})" for c in conds)) if conds else ""
    lang = spec.lang_sql or "CAST(NULL AS VARCHAR)"
    return (f"SELECT CAST({spec.id_sql} AS BIGINT) AS local_id, CAST({spec.turn_sql} AS BIGINT) AS local_turn, {spec.text_sql} AS raw, {lang} AS lang "
            f"FROM {spec.table}{where}")


def band_sql(col: str, lo: int, hi, inclusive: bool) -> str:
    if inclusive:
        return f"length({col}) >= {lo}" + (f" AND length({col}) <= {hi}" if hi is not None else "")
    return f"length({col}) > {lo}" + (f" AND length({col}) < {hi}" if hi is not None else "")


def collect_source_sql(spec, rank: int) -> str:
    kw = ""
    if spec.include:
        kw += f" AND {rx('raw', spec.include, True)}"
    if spec.exclude:
        kw += f" AND NOT {rx('raw', spec.exclude, True)}"
    base = (f"SELECT local_id, local_turn, raw, lang FROM ({spec_rows_sql(spec)}) WHERE raw IS NOT NULL AND "
            f"{band_sql('raw', spec.min_len, spec.max_len, spec.inclusive)}{kw} "
            f"QUALIFY row_number() OVER (PARTITION BY md5(raw) ORDER BY local_id, local_turn) = 1")
    shown = clean_sql("raw") if spec.cut is None else f"substr({clean_sql('raw')}, 1, {spec.cut})"
    cleaned = f"SELECT local_id, local_turn, {shown} AS text, lang FROM ({base})"
    head = (f"SELECT CAST('0x' || substr(md5(concat_ws(':', {rank}, local_id, local_turn)), 1, 15) AS BIGINT) AS case_id, local_id, local_turn, text, "
            f"{lit(spec.label)} AS label, {lit(spec.name)} AS source, {rank} AS source_rank")
    if spec.lang_quotas is None or spec.lang_sql is None:
        n = spec.quota if spec.quota is not None else (sum(spec.lang_quotas) if spec.lang_quotas else None)
        q = f" QUALIFY row_number() OVER (ORDER BY local_id, local_turn) <= {n}" if n is not None else ""
        return f"{head}, CAST(NULL AS VARCHAR) AS lang, 0 AS bucket_order FROM ({cleaned}){q}"
    n_en, n_de = spec.lang_quotas
    if spec.lang_mode == "exact":
        en_ok, de_ok = "lang = 'en'", "lang = 'de'"
    else:
        en_ok = "(contains(lang, 'en') OR contains(lang, 'english'))"
        de_ok = "(contains(lang, 'de') OR contains(lang, 'german'))"
    en = f"SELECT * FROM ({cleaned}) WHERE {en_ok} QUALIFY row_number() OVER (ORDER BY local_id, local_turn) <= {n_en}"
    de = (f"SELECT * FROM ({cleaned}) WHERE {de_ok} AND (local_id, local_turn) NOT IN (SELECT (local_id, local_turn) FROM ({en})) "
          f"QUALIFY row_number() OVER (ORDER BY local_id, local_turn) <= {n_de}")
    return (f"{head}, 'en' AS lang, 0 AS bucket_order FROM ({en}) UNION ALL "
            f"{head}, 'de' AS lang, 1 AS bucket_order FROM ({de})")


def union_sources_sql(specs=None) -> str:
    from veilspark.sources.registry import SOURCES
    specs = specs or SOURCES
    return " UNION ALL ".join(f"({collect_source_sql(s, i)})" for i, s in enumerate(specs, start=1))


def case_id_sql(rank: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {rank}, local_id, local_turn)), 1, 15) AS BIGINT)"


def corpus_sql(specs=None, labelled: str | None = None) -> str:
    from veilspark.sources.registry import SOURCES
    union = union_sources_sql(specs)
    if labelled is not None:
        rank = len(specs or SOURCES) + 1
        union += (f" UNION ALL (SELECT {case_id_sql(str(rank))} AS case_id, local_id, local_turn, text, label, 'labelled' AS source, "
                  f"{rank} AS source_rank, CAST(NULL AS VARCHAR) AS lang, 0 AS bucket_order "
                  f"FROM (SELECT case_id AS local_id, 0::BIGINT AS local_turn, text, label FROM ({labelled})))")
    u = f"SELECT * REPLACE ({strip_sql('text')} AS text) FROM ({union})"
    f = f"SELECT *, md5(text) AS fp FROM ({u}) WHERE length(text) >= 10"
    return (f"SELECT case_id, text, label, source, source_rank, lang, fp FROM ({f}) "
            f"QUALIFY row_number() OVER (PARTITION BY fp ORDER BY source_rank, bucket_order, local_id, local_turn) = 1")


def seeded_hash_sql(id_col: str, seed, *salt) -> str:
    parts = [lit(str(seed))] + [lit(str(s)) for s in salt] + [f"CAST({id_col} AS VARCHAR)"]
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def split_sql(src: str, id_col: str = "case_id", seed: int = 42, kind: str = "60/20/20") -> str:
    """Rows of src + rank + n_total + split."""
    h = seeded_hash_sql(id_col, seed)
    ranked = (f"SELECT *, row_number() OVER (ORDER BY {h}, {id_col}) AS rank, count(*) OVER () AS n_total "
              f"FROM ({src})")
    if kind == "50/50":
        s = "CASE WHEN rank <= n_total // 2 THEN 'dev' ELSE 'test' END"
    else:
        s = ("CASE WHEN rank <= floor(CAST(n_total AS DOUBLE) * 0.6::DOUBLE) THEN 'train' "
             "WHEN rank <= floor(CAST(n_total AS DOUBLE) * 0.8::DOUBLE) THEN 'dev' ELSE 'test' END")
    return f"SELECT *, {s} AS split FROM ({ranked})"
