"""Deterministic ranks, splits and samples.

Exact seeded splits need a *global* rank. ``row_number() over (order by h)``
would plan ``Exchange SinglePartition`` (one task sorts everything). Instead
``exact_rank`` buckets rows by a hex prefix of the seeded md5, counts per
bucket (<= 16^prefix rows, a size bound known in advance, so the offsets table
may be broadcast), turns counts into running offsets on that tiny table, and
ranks inside each bucket in parallel: rank = offset(bucket) + row_number
within bucket. Order is by (md5, id), identical to the single global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT_BUCKETS = 64


def seeded_hash(id_col: Column, seed: int | str, *salt) -> Column:
    """md5 of "seed|[salt|...]id" -- the seeded order of J1-J5."""
    parts = [F.lit(str(seed))] + [F.lit(str(s)) for s in salt] + [id_col.cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def exact_rank(df: DataFrame, hash_col: str, tie_col: str, prefix_len: int = 4,
               rank_col: str = "rank", total_col: str = "n_total") -> DataFrame:
    """Global 1-based rank by (hash_col, tie_col) without a single-partition
    sort; adds ``rank_col`` and ``total_col`` (row count)."""
    b = F.substring(F.col(hash_col), 1, prefix_len)
    keyed = df.withColumn("_b", b)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # <= 16^prefix_len rows: the running sum over it is a tiny single-task window
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy()).alias(total_col))
    within = Window.partitionBy("_b").orderBy(F.col(hash_col), F.col(tie_col))
    return (keyed.join(F.broadcast(offsets), "_b")
            .withColumn(rank_col, F.col("_off") + F.row_number().over(within))
            .drop("_b", "_off"))


def cut(n: Column, frac: float) -> Column:
    """Python ``int(n * frac)`` (float product, truncation)."""
    return F.floor(n.cast("double") * F.lit(float(frac)))


def split_train_dev_test(df: DataFrame, id_col: str = "case_id", seed: int = 42,
                         train: float = 0.6, dev: float = 0.8) -> DataFrame:
    """train = first floor(.6n) of the seeded order, dev up to floor(.8n),
    test the rest. Sizes exact, splits disjoint, independent of partitioning."""
    r = exact_rank(df.withColumn("_h", seeded_hash(F.col(id_col), seed)), "_h", id_col)
    n = F.col("n_total")
    split = (F.when(F.col("rank") <= cut(n, train), F.lit("train"))
              .when(F.col("rank") <= cut(n, dev), F.lit("dev")).otherwise(F.lit("test")))
    return r.withColumn("split", split).drop("_h")


def split_holdout(df: DataFrame, id_col: str = "case_id", seed: int = 42) -> DataFrame:
    """dev = first n // 2 of the seeded order, test (holdout) the rest."""
    r = exact_rank(df.withColumn("_h", seeded_hash(F.col(id_col), seed)), "_h", id_col)
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("n_total") / 2), F.lit("dev"))
                        .otherwise(F.lit("test"))).drop("_h")


def cut_keys(df: DataFrame, cuts: list, id_col: str, seed: int) -> DataFrame:
    """One row, one struct (hash, id) for each of ``cuts`` (functions of the
    total's column): the key of the row with that rank in the seeded order, null
    for rank 0. Only ids are read; beyond the counts per bucket only the rows
    of the buckets that hold a cut are shuffled."""
    keyed = df.select(F.col(id_col).alias("_id"), seeded_hash(F.col(id_col), seed).alias("_h")) \
        .withColumn("_b", F.substring("_h", 1, 4))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy()).alias("_n"))
    at = offsets.select("_b", "_c", "_off", F.posexplode(F.array(*[c(F.col("_n")) for c in cuts])).alias("_i", "_k")) \
        .where((F.col("_off") < F.col("_k")) & (F.col("_k") <= F.col("_off") + F.col("_c")))  # at most one row a cut
    ranked = keyed.join(F.broadcast(at), "_b") \
        .withColumn("_r", F.col("_off") + F.row_number().over(Window.partitionBy("_i").orderBy("_h", "_id")))
    found = ranked.where(F.col("_r") == F.col("_k")).select("_i", F.struct("_h", "_id").alias("_key"))
    return found.agg(*[F.max(F.when(F.col("_i") == i, F.col("_key"))).alias(f"k{i}") for i in range(len(cuts))])


def label_splits(df: DataFrame, cuts: list[tuple[str, object]], last: str, id_col: str = "case_id", seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the name of the first cut whose key is not below the
    row's, else ``last``. The same splits as by rank (J1, J2), but the rows stay
    where they are: none is shuffled. Rows that repeat an id share a split."""
    keys = cut_keys(df, [c for _, c in cuts], id_col, seed).select(F.struct("*")).scalar()
    own = F.struct(seeded_hash(F.col(id_col), seed).alias("_h"), F.col(id_col).alias("_id"))
    split = F.lit(last)
    for i, (name, _) in reversed(list(enumerate(cuts))):
        split = F.when(own <= keys.getField(f"k{i}"), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def label_train_dev_test(df: DataFrame, id_col: str = "case_id", seed: int = 42,
                         train: float = 0.6, dev: float = 0.8) -> DataFrame:
    """J2 without ranks."""
    return label_splits(df, [("train", lambda n: cut(n, train)), ("dev", lambda n: cut(n, dev))], "test", id_col, seed)


def label_holdout(df: DataFrame, id_col: str = "case_id", seed: int = 42) -> DataFrame:
    """J1 without ranks."""
    return label_splits(df, [("dev", lambda n: F.floor(n / 2))], "test", id_col, seed)


def first_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                      rank_col: str = "pos") -> DataFrame:
    """H1 quota: first n rows per group in ``order``, found per (group, bucket) and
    then among those, so no task sorts more than one bucket's rows or
    ``LIMIT_BUCKETS * n``, however many input partitions there are. For n within
    the WindowGroupLimit threshold both limits also run before their shuffle."""
    parts = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(LIMIT_BUCKETS)))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = parts.withColumn("_inner", F.row_number().over(inner)).where(F.col("_inner") <= n).drop("_bucket", "_inner")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def seeded_sample(df: DataFrame, k: int, id_col: str = "case_id", seed: int = 42, *salt) -> DataFrame:
    """Uniform k-subset by smallest seeded hash. ``orderBy().limit(k)``
    plans TakeOrderedAndProject: top-k per partition, then a k-row merge."""
    return df.withColumn("_h", seeded_hash(F.col(id_col), seed, *salt)).orderBy("_h", id_col).limit(k).drop("_h")


def seeded_samples(df: DataFrame, k: int, rounds: list[int], id_col: str = "case_id", seed: int = 42) -> DataFrame:
    """J5 for many rounds at once: ``round`` and the columns of ``df``, for each
    round the rows of ``seeded_sample(df, k, id_col, seed, round)``. Ids are read
    once for all rounds and cut to k a round before and after their shuffle; the
    at most ``k * len(rounds)`` chosen ones then fetch their rows. Ids are unique."""
    drawn = df.select(id_col, F.explode(F.array(*[F.lit(r) for r in rounds])).alias("round"))
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col(id_col).cast("string"))))
    chosen = first_n_per_group(drawn, ["round"], [F.col("_h"), F.col(id_col)], k).select("round", id_col)
    return df.join(F.broadcast(chosen), id_col).select("round", *df.columns)


def balanced_sample(train: DataFrame, cap: int = 200, order_col: str = "rank") -> DataFrame:
    """min(n_S, n_P, cap) rows of each class, first in train order. The
    per-class cut is planned as a WindowGroupLimit (cap <= threshold); the
    class counts are a two-row aggregate joined back by label."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    k = counts.select(F.least(F.min("_n").over(Window.partitionBy()), F.lit(cap)).alias("_k"), "label")
    top = first_n_per_group(train, ["label"], [F.col(order_col)], cap)
    return top.join(F.broadcast(k), "label").where(F.col("pos") <= F.col("_k")).drop("_k")
