"""Evaluation: confusion counts, rates, latency, utilities, samples,
leaderboards and constrained choice (F1-F10, H3-H6, E4, E6).

All of it is one ``groupBy`` with partial (map-side) aggregation per metric
table; leaderboards then work on one row per config (a tiny table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.answers import PUBLIC, SENSITIVE, normalise_label
from veilspark.functions.text import preview


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def confusion(pred: DataFrame, by: list[str] | tuple[str, ...] = ("config_id",), definition: str = "v1") -> DataFrame:
    """F2 + F4 per group. Definitions of a miss:
      v1       (v1-v7) FN = SENSITIVE->PUBLIC, every other miss is FP;
      v0       FN = SENSITIVE->PUBLIC, FP = PUBLIC->SENSITIVE, other misses neither;
      fewshot  any SENSITIVE miss is FN, any PUBLIC miss is FP.
    """
    lab, prd = F.col("label"), F.col("predicted")
    ok = prd == lab
    if definition == "v1":
        fn = (lab == SENSITIVE) & (prd == PUBLIC)
        fp = ~ok & ~fn
    elif definition == "v0":
        fn = (lab == SENSITIVE) & (prd == PUBLIC)
        fp = (lab == PUBLIC) & (prd == SENSITIVE)
    elif definition == "fewshot":
        fn = ~ok & (lab == SENSITIVE)
        fp = ~ok & (lab != SENSITIVE)
    else:
        raise ValueError(definition)
    lat = F.coalesce(F.col("latency_ms"), F.lit(0.0)) if "latency_ms" in pred.columns else F.lit(0.0)
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        _cnt(lab == SENSITIVE).alias("n_sensitive"),
        _cnt(lab == PUBLIC).alias("n_public"),
        _cnt(ok).alias("correct"),
        _cnt(fn).alias("false_negatives"),
        _cnt(fp).alias("false_positives"),
        _cnt(lat > 0).alias("llm_calls"),
        F.sum(lat).alias("total_latency_ms"),
    )


def rate(num: Column, den: Column) -> Column:
    """num * 100 / den as double; 0 when the class is empty."""
    return F.when(den > 0, num.cast("double") * F.lit(100.0) / den.cast("double")).otherwise(F.lit(0.0))


def _pct(num: Column, den: Column) -> Column:
    """Display rate with one decimal, half-up on the exact ratio num*100/den,
    in integer arithmetic so it does not depend on binary rounding. (Python's
    round() is half-even on the binary value; it can differ in the last digit.)"""
    return F.when(den > 0, F.floor((num * F.lit(2000) + den) / (den * F.lit(2))).cast("double") / F.lit(10.0)) \
            .otherwise(F.lit(0.0))


def metrics(conf: DataFrame) -> DataFrame:
    """F3 + F4: rates (unrounded and display), mean latency per call, seconds."""
    c = F.col
    return conf.select(
        "*",
        rate(c("correct"), c("total")).alias("accuracy"),
        rate(c("false_negatives"), c("n_sensitive")).alias("fnr"),
        rate(c("false_positives"), c("n_public")).alias("fpr"),
        _pct(c("correct"), c("total")).alias("accuracy_pct"),
        _pct(c("false_negatives"), c("n_sensitive")).alias("fnr_pct"),
        _pct(c("false_positives"), c("n_public")).alias("fpr_pct"),
        F.when(c("llm_calls") > 0, c("total_latency_ms") / c("llm_calls").cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        (c("total_latency_ms") / F.lit(1000.0)).alias("total_time_s"),
    )


def combined_scores(m: DataFrame) -> DataFrame:
    """F6 on the display rates: fnr+fpr, fnr+0.5*fpr, 2*fnr+fpr."""
    c = F.col
    return m.select("*",
                    (c("fnr_pct") + c("fpr_pct")).alias("score_sum"),
                    (c("fnr_pct") + c("fpr_pct") * F.lit(0.5)).alias("score_half_fpr"),
                    (c("fnr_pct") * F.lit(2.0) + c("fpr_pct")).alias("score_double_fnr"))


def outcome_utility(label: Column, predicted: Column, hit: float = 1.0, leak: float = -2.0,
                    false_alarm: float = 0.0) -> Column:
    """M3: a metric as a Column. The answer is normalised first (B14), so raw
    scorer output may be given; what cannot be read counts as SENSITIVE."""
    answer = normalise_label(F.coalesce(predicted, F.lit("")))
    return (F.when(answer == label, F.lit(hit)).when((label == SENSITIVE) & (answer == PUBLIC), F.lit(leak))
             .otherwise(F.lit(false_alarm)))


def mean_utility(pred: DataFrame, metrics: dict[str, Column], by=("config_id",)) -> DataFrame:
    """The mean of each given metric per group, and the group's size."""
    sums = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in metrics.items()])
    return sums.select(*by, "n", *[(F.col(name) / F.col("n").cast("double")).alias(name) for name in metrics])


def weighted_utility(pred: DataFrame, by=("config_id",)) -> DataFrame:
    """hit 1, leak -2, false alarm 0, averaged; plus plain accuracy."""
    label, answer = F.col("label"), F.col("predicted")
    sums = pred.groupBy(*by).agg(F.sum(outcome_utility(label, answer)).alias("utility_sum"), F.count(F.lit(1)).alias("n"),
                                 F.count_if(normalise_label(answer) == label).alias("hits"))
    return sums.select(*by, "utility_sum", "n", "hits",
                       (F.col("utility_sum") / F.col("n").cast("double")).alias("weighted_utility"),
                       (F.col("hits").cast("double") / F.col("n").cast("double")).alias("plain_accuracy"))


def leaderboard(m: DataFrame, order: str) -> DataFrame:
    """H3-H5 over one row per config; ties broken by config_id.
      accuracy: accuracy desc, fnr asc (v2); fnr: fnr asc (v3);
      combined: fnr+fpr asc with TARGET flag fnr<3 and fpr<15 (v4+)."""
    c = F.col
    if order == "accuracy":
        keys = [c("accuracy_pct").desc(), c("fnr_pct").asc(), c("config_id").asc()]
    elif order == "fnr":
        keys = [c("fnr_pct").asc(), c("config_id").asc()]
    elif order == "combined":
        keys = [(c("fnr_pct") + c("fpr_pct")).asc(), c("config_id").asc()]
    else:
        raise ValueError(order)
    # one row per config: a global window over a tiny aggregate
    out = m.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    if order == "combined":
        out = out.withColumn("score", c("fnr_pct") + c("fpr_pct")) \
                 .withColumn("target", (c("fnr_pct") < 3.0) & (c("fpr_pct") < 15.0))
    return out


def best_config(m: DataFrame, max_fpr: float | Column | None = 20.0) -> DataFrame:
    """H6: among fpr < max_fpr (a number, or a column of the metrics table), min fnr + 0.5*fpr; ties -> lowest config_id
    (Python ``min`` keeps the first); no row if none qualifies."""
    c = F.col
    if max_fpr is None:
        q = m
    else:
        q = m.withColumn("_max", F.lit(max_fpr)).where(c("fpr_pct") < c("_max")).drop("_max")
    return q.orderBy((c("fnr_pct") + c("fpr_pct") * 0.5).asc(), c("config_id").asc()).limit(1)


def misses(pred: DataFrame, n_chars: int = 100, by=("config_id",)) -> DataFrame:
    """every leak and false alarm as a row, with a preview of the text and
    the method that decided."""
    return pred.where(F.col("outcome") != "OK") \
        .select(*by, "outcome", "case_id", preview(F.col("text"), n_chars).alias("preview"), "method")


def leak_samples(pred: DataFrame, k: int = 10, n_chars: int = 100, by=("config_id",)) -> DataFrame:
    """first k leaks and false alarms per group in case order. The cap k
    is the feature (the reference keeps ``leaks[:10]``); row_number <= k is
    planned as a WindowGroupLimit below the shuffle, so no group is gathered
    whole."""
    w = Window.partitionBy(*by, "outcome").orderBy("case_id")
    s = pred.where(F.col("outcome") != "OK") \
        .select(*by, "outcome", "case_id", preview(F.col("text"), n_chars).alias("preview")) \
        .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return s


def stage_coverage(pred: DataFrame, by=("config_id",)) -> DataFrame:
    """F8: share of cases settled by the rules, per gold label."""
    return pred.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("method").startswith("regex:")).alias("rule_decided")) \
        .withColumn("rule_share", F.col("rule_decided").cast("double") / F.col("n").cast("double"))


def rule_hit_counts(classified: DataFrame) -> DataFrame:
    """hits per rule name (matches exploded)."""
    return classified.select(F.explode("matches").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))


def corpus_composition(cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """class counts and percentages of a corpus."""
    g = cases.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    tot = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("total")) if by else None
    if by:
        g = g.join(tot, list(by))
    else:
        g = g.withColumn("total", F.sum("n").over(Window.partitionBy()))  # tiny: one row per label
    return g.withColumn("share_pct", F.col("n").cast("double") * 100.0 / F.col("total").cast("double"))
