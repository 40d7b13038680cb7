"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are counted by membership
pattern (the set of their sources), so the flow has one node a pattern and one a
source, however many documents there are. Words flow from a pattern into the
quotas of its sources. A pattern gives its words once at no cost, a second time
at a cost, a third time at a higher one: the cost is convex, so the tier of least
cost is always opened first, and augmenting paths tier by tier (a residual path
may hand words of one source's quota to another) end in a flow of greatest value
and, among those, least cost.

The flow says how many words of a pattern go to each source. The pattern's
documents lie on a tape in seeded order; the tape is read from its beginning, up
to ``MOST_REPEATS`` times, and cut at the flow's amounts. A document's words lie
in one segment or, at a cut, in two; the last one read may be taken in part. So
every quota that the flow fills is met to the word, and reruns agree.

Positions on a tape are prefix sums. Rows that agree in everything are counted
first; sums per (pattern, bucket of the seeded hash) become offsets, and only
rows of one bucket meet in a task, also where one pattern holds most rows.

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating,
and share all words. No target lies above ``MOST_REPEATS`` times its source's
words; what is cut off is shared out again by weight among the others, until
none is above.

Bounds: at most ``MOST_PATTERNS`` patterns are brought to the driver; more raise
an error before any is. Defined cases: a null text has size 0; a null source is a
source of its own; a document without any source takes no part; documents of
size 0 take nothing; repeated rows are documents of their own (equal ones are
interchangeable); null ids are carried; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, small_table, whole_text

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
MOST_PATTERNS = 50_000
BUCKETS = 4096
#: Equal rows are written out in parts of this many.
PART = 1024
WORD = r"[^\x20\x09-\x0D]+"

FLOWS = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("sources", T.ArrayType(T.StringType())),
                      T.StructField("ends", T.ArrayType(T.LongType()))])
TARGETS = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def in_order(sources) -> list:
    """By code points, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights=WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, Fraction]:
    """Each source's target, exactly. ``sizes``: its words."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(in_order(sizes))}
    total, full, free = Fraction(sum(sizes.values())), {}, set(sizes)
    while free:
        share = (total - sum(full.values())) / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > most * sizes[s]}
        if not above:
            return full | {s: share * weight[s] for s in free}
        full |= {s: Fraction(most * sizes[s]) for s in above}
        free -= above
    return full


def flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """Words of each pattern for each of its sources: of greatest total within
    ``quotas``, and then of least cost of repetition."""
    sent = {p: dict.fromkeys(p, 0) for p in patterns}
    left, supply = dict(quotas), dict.fromkeys(patterns, 0)
    of_source: dict = {}
    for p in patterns:
        for s in p:
            of_source.setdefault(s, []).append(p)
    for _ in range(most):  # one tier of cost after the other
        supply = {p: supply[p] + size for p, size in patterns.items()}
        for start in patterns:
            while supply[start] and (path := augmenting(start, sent, left, of_source)):
                push = min([supply[start], left[path[-1]], *(sent[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2))])
                for i in range(0, len(path), 2):
                    sent[path[i]][path[i + 1]] += push
                    if i:
                        sent[path[i]][path[i - 1]] -= push
                supply[start] -= push
                left[path[-1]] -= push
    return sent


def augmenting(start: tuple, sent: dict, left: dict, of_source: dict) -> list | None:
    """The shortest path pattern, source, pattern, ... from ``start`` to a source
    with room: forward to any source of a pattern, back along words sent."""
    came, queue = {("p", start): None}, deque([start])
    while queue:
        p = queue.popleft()
        for s in p:
            if ("s", s) in came:
                continue
            came["s", s] = ("p", p)
            if left[s] > 0:
                path, at = [], ("s", s)
                while at is not None:
                    path.append(at[1])
                    at = came[at]
                return path[::-1]
            for other in of_source[s]:
                if ("p", other) not in came and sent[other][s] > 0:
                    came["p", other] = ("s", s)
                    queue.append(other)
    return None


def sized(docs: DataFrame, sources: Column) -> DataFrame:
    """``doc_id, pattern, size``: the pattern is the sorted set of ``sources``."""
    pattern = F.array_sort(F.array_distinct(sources))  # null last
    rows = docs.select("doc_id", pattern.alias("pattern"), words(whole_text()).alias("size"))
    return rows.where(F.size("pattern") > 0)


def on_tape(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``at``: the words before them on their pattern's tape."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    counted = rows.groupBy("pattern", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("_h", order) \
        .withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)))
    sums = counted.groupBy("pattern", "_bucket").agg(F.sum(F.col("size") * F.col("n")).alias("_words"))
    before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows a pattern
    offsets = sums.select("pattern", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("pattern", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0))
    placed = counted.withColumn("_in", first).join(offsets, ["pattern", "_bucket"])
    # equal rows one after another, in parts
    parts = placed.select("pattern", "doc_id", "size", "n", (F.col("_offset") + F.col("_in")).alias("_at"),
                          F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART))).alias("_part"))
    within = F.sequence(F.col("_part") * PART, F.least(F.col("n"), (F.col("_part") + 1) * PART) - 1)
    return parts.withColumn("_copy", F.explode(within)) \
        .select("pattern", "doc_id", "size", (F.col("_at") + F.col("_copy") * F.col("size")).alias("at"))


def mix(docs: DataFrame, sources: Column, weights=WEIGHTS, seed: int = 42) -> DataFrame:
    """``doc_id, pattern, size, taken, parts``: for each document the words taken,
    repeats counted, in all and for each source (``parts``: source, words)."""
    rows = land(sized(docs, sources), "mix-sizes")
    return _mixed(rows, *plan(rows, weights), seed)


def plan(rows: DataFrame, weights=WEIGHTS) -> tuple[dict, dict, dict, dict]:
    """Words of each pattern, of each source, the sources' targets, and the flow."""
    by_pattern = land(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    if by_pattern.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns; merge sources first")
    patterns = {tuple(r["pattern"]): r["size"] for r in by_pattern.orderBy("pattern").collect()}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    goal = targets(sizes, weights)
    return patterns, sizes, goal, flow(patterns, {s: int(t) for s, t in goal.items()})


def _mixed(rows: DataFrame, patterns: dict, sizes: dict, goal: dict, sent: dict, seed: int) -> DataFrame:
    spark, flows = rows.sparkSession, []
    for p, own in sent.items():
        ends, at = [], 0
        for s in p:
            at += own[s]
            ends.append(at)
        flows.append({"pattern": list(p), "sources": list(p), "ends": ends})
    lengths = small_table(spark, [{"pattern": list(p), "ends": [size]} for p, size in patterns.items()], FLOWS) \
        .select("pattern", F.col("ends")[0].alias("tape"))
    cuts = small_table(spark, flows, FLOWS).join(F.broadcast(lengths), "pattern")  # at most MOST_PATTERNS rows each
    joined = on_tape(rows, seed).join(F.broadcast(cuts), "pattern")

    def overlap(lo: Column, hi: Column) -> Column:
        """Words of the document on [lo, hi) of the tape read MOST_REPEATS times."""
        total = F.lit(0).cast("long")
        for turn in range(MOST_REPEATS):
            at = F.col("at") + turn * F.col("tape")
            total = total + F.greatest(F.least(hi, at + F.col("size")) - F.greatest(lo, at), F.lit(0))
        return total

    def part(source: Column, i: Column) -> Column:
        lo = F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0))
        return F.struct(source.alias("source"), overlap(lo, F.get("ends", i)).alias("words"))

    parts = F.filter(F.transform("sources", part), lambda x: x["words"] > 0)
    return joined.select("doc_id", "pattern", "size", overlap(F.lit(0), F.element_at("ends", -1)).alias("taken"), parts.alias("parts"))


def target_table(rows: DataFrame, sizes: dict, goal: dict) -> DataFrame:
    return small_table(rows.sparkSession, [{"source": s, "source_size": sizes[s], "target": float(goal[s])} for s in in_order(sizes)], TARGETS)


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Documents with one source each, mixed to the default weights: ``doc_id,
    size, source_size, target, taken, source``."""
    rows = land(sized(docs, F.array("source")), "mix-sizes")
    patterns, sizes, goal, sent = plan(rows)
    mixed = _mixed(rows, patterns, sizes, goal, sent, seed).withColumn("source", F.col("pattern")[0])
    told = F.broadcast(target_table(rows, sizes, goal))  # at most MOST_PATTERNS rows
    return mixed.join(told.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))) \
        .select("doc_id", "size", "source_size", "target", "taken", "source")
