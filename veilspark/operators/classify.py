"""Stage-1 rule classification.

``classify`` adds ``verdict`` (SENSITIVE / UNCERTAIN) and ``matches`` (rule
names in rule order). Each detector appears once in the plan: the match array
is projected once and verdict/labels are derived from that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import rules as R
from veilspark.functions.answers import PUBLIC, SENSITIVE, UNCERTAIN
from veilspark.operators.joins import spread

CODE_CONTEXT = "code_context"


def guard(text: Column, kind: str) -> Column:
    """code/example guard (always ignoring case)."""
    return R.any_match(text, R.GUARDS[kind], ignore_case=True)


def classify(df: DataFrame, rule_set: str = "v4", text_col: str = "text") -> DataFrame:
    """Guards matter to hits alone, so they are searched for after the rules and
    only there; rows without a digit skip the numeric rules."""
    rs = R.RULE_SETS[rule_set]
    text, digit = F.col(text_col), F.col("_digit")
    cols = [F.col(c) for c in df.columns]
    step = spread(df).select(*cols, R.has_digit(text).alias("_digit"))
    step = step.select(*cols, "_digit", R.hit_names(text, rs.tiers[0], rs.ignore_case, digit).alias("_m"))
    if rs.mode == "tiered":
        # context tier only when the structured tier is empty
        m = F.when(F.size("_m") > 0, F.col("_m")).otherwise(R.hit_names(text, rs.tiers[1], rs.ignore_case, digit))
        step = step.select(*cols, m.alias("_m"))
    elif rs.mode not in ("plain", "guard_first"):
        raise ValueError(f"unknown rule-set mode {rs.mode}")
    hit = F.size("_m") > 0
    code = F.when(hit, R.any_match(text, rs.guards, ignore_case=True)).otherwise(F.lit(False))
    step = step.select(*cols, "_m", code.alias("_code"))
    if rs.mode == "tiered":  # the names stand, the guard is added to them
        names = F.concat(F.col("_m"), F.array(F.lit(CODE_CONTEXT)))
    else:
        names = F.array().cast("array<string>")
    return step.select(
        *cols, F.when(F.col("_code"), names).otherwise(F.col("_m")).alias("matches"),
        F.when(hit & ~F.col("_code"), F.lit(SENSITIVE)).otherwise(F.lit(UNCERTAIN)).alias("verdict"))


def classify_fast(df: DataFrame, rule_set: str = "v4", text_col: str = "text") -> DataFrame:
    """Early-exit boolean form (no names): NOT guard AND (p1 OR p2 ...)."""
    rs = R.RULE_SETS[rule_set]
    text = F.col(text_col)
    keys = [k for _, k in rs.tiers[0]]
    df = spread(df).withColumn("_digit", R.has_digit(text))
    hit = R.any_match(text, keys, rs.ignore_case, F.col("_digit")) & ~R.any_match(text, rs.guards, True)
    return df.withColumn("rule_hit", hit).drop("_digit")


def method_of_rules(matches: Column) -> Column:
    return F.concat(F.lit("regex:"), F.array_join(matches, ","))


def rules_only(df: DataFrame, rule_set: str = "v1", uncertain_as: str | None = PUBLIC) -> DataFrame:
    """Rules-only baseline. v1 counts UNCERTAIN as PUBLIC with method
    ``regex:no_match``; v0 (``uncertain_as=None``) leaves UNCERTAIN standing."""
    c = classify(df, rule_set)
    if uncertain_as is None:
        pred, method = F.col("verdict"), method_of_rules(F.col("matches"))
    else:
        unc = F.col("verdict") == F.lit(UNCERTAIN)
        pred = F.when(unc, F.lit(uncertain_as)).otherwise(F.col("verdict"))
        method = F.when(unc, F.lit("regex:no_match")).otherwise(method_of_rules(F.col("matches")))
    return c.withColumn("predicted", pred).withColumn("method", method).withColumn("latency_ms", F.lit(0.0))
