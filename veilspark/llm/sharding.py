"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``segments`` equal pieces and every shard owns ``vnodes``
points on it. A row's hash names its segment, and the segment's walk is the
list of distinct shards met clockwise from it. Shards have a capacity. Rows go
to the first shard of their walk; what a full shard cannot take continues
clockwise to the next one, so no shard ever exceeds its capacity and only
overflowing rows leave their home shard.

Only the row counts of the segments reach the driver (``segments`` numbers, a
parameter), where the walk is settled: for each segment, which run of its rows
goes to which shard and from which slot on. Rows equal in id, checksum and size
are counted where they are read and become one row with a number; these are
ranked inside their segment and read their shard and slots from that plan,
which is broadcast (at most ``segments * shards`` entries, in practice little
over ``segments``). Last, each becomes as many rows as it counts, those of more
than ``CHUNK`` in parts that are dealt over all tasks. No task ranks or writes
the rows of a large group of equal ones alone. Texts never leave the scan; two
shuffles carry about 40 bytes a distinct row.

Defined cases: a null text has size 1 and the checksum of the empty text; a
null or repeated ``doc_id`` is placed by id and checksum together, so rows with
such an id spread over the ring by their texts; equal rows are interchangeable,
lie in one segment and each gets its own slot; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_table, utf8_bytes, whole_text

SEGMENT_BITS = 13
CHUNK = 1 << 14

PLAN = T.StructType([
    T.StructField("p_segment", T.LongType()),
    T.StructField("p_from", T.LongType()),
    T.StructField("p_to", T.LongType()),
    T.StructField("p_shard", T.IntegerType()),
    T.StructField("p_slot", T.LongType()),
])


def ring_walks(shards: int, vnodes: int, segments: int) -> list[list[int]]:
    """For each segment, the distinct shards met clockwise from it. A point's
    place depends on its shard and number alone, so one more shard adds points
    and moves none."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big") % segments, digest, shard))
    points.sort()
    walks, at = [], 0
    for segment in range(segments):
        while at < len(points) and points[at][0] < segment:
            at += 1
        walk: list[int] = []
        for i in range(len(points)):
            shard = points[(at + i) % len(points)][2]
            if shard not in walk:
                walk.append(shard)
                if len(walk) == shards:
                    break
        walks.append(walk)
    return walks


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """``load`` 1: the exact share, counts at most one apart. Above 1: every
    shard may take ``load`` times its share, for less movement."""
    if load <= 1.0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load * rows // shards)] * shards


def settle(counts: list[int], walks: list[list[int]], capacity: list[int]) -> list[dict]:
    """Runs of rows by segment: first every segment offers its rows to its home
    shard, then what is left to the next shard of the walk, and so on."""
    left, placed, used, runs = list(counts), [0] * len(counts), [0] * len(capacity), []
    for step in range(len(capacity)):
        for segment, walk in enumerate(walks):
            shard = walk[step]
            take = min(left[segment], capacity[shard] - used[shard])
            if take > 0:
                runs.append({"p_segment": segment, "p_from": placed[segment], "p_to": placed[segment] + take,
                             "p_shard": shard, "p_slot": used[shard]})
                left[segment] -= take
                placed[segment] += take
                used[shard] += take
    return runs


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64, load: float = 1.0) -> DataFrame:
    """Place every row of ``docs(doc_id, text)``.

    Returns ``doc_id, size, text_crc32, shard, slot, home_shard``: ``slot``
    counts gapless from 0 inside a shard, ``home_shard`` is where the row would
    be without the bound."""
    spark, segments = docs.sparkSession, 1 << SEGMENT_BITS
    text = whole_text()
    keyed = docs.select("doc_id", (utf8_bytes(text) + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = keyed.withColumn("_h", F.xxhash64("doc_id", "text_crc32"))
    keyed = keyed.withColumn("_segment", F.shiftrightunsigned("_h", 64 - SEGMENT_BITS))
    counts = [0] * segments
    for row in keyed.groupBy("_segment").count().collect():
        counts[row["_segment"]] = row["count"]
    walks = ring_walks(shards, vnodes, segments)
    plan = small_table(spark, settle(counts, walks, capacities(sum(counts), shards, load)), PLAN)
    homes = F.array(*[F.lit(w[0]) for w in walks])
    same = keyed.groupBy("_segment", "_h", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_segment").orderBy("_h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = ranked.join(F.broadcast(plan), (F.col("_segment") == F.col("p_segment"))
                       & (F.col("_at") < F.col("p_to")) & (F.col("_at") + F.col("_n") > F.col("p_from")))
    low, high = F.greatest("_at", "p_from"), F.least(F.col("_at") + F.col("_n"), F.col("p_to"))
    runs = runs.select("doc_id", "size", "text_crc32", F.col("p_shard").alias("shard"), (F.col("p_slot") + low - F.col("p_from")).alias("_slot"),
                       (high - low).alias("_rows"), F.get(homes, F.col("_segment").cast("int")).alias("home_shard"))
    few, many = runs.where(F.col("_rows") <= CHUNK), runs.where(F.col("_rows") > CHUNK)
    steps = F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(CHUNK).cast("long"))
    parts = many.withColumn("_step", F.explode(steps)) \
        .withColumns({"_slot": F.col("_slot") + F.col("_step"), "_rows": F.least(F.lit(CHUNK).cast("long"), F.col("_rows") - F.col("_step"))}) \
        .drop("_step").repartition("shard", "_slot")  # chunks of equal rows are dealt out before they are written row by row
    slots = F.explode(F.sequence(F.col("_slot"), F.col("_slot") + F.col("_rows") - 1))
    return few.unionByName(parts).select("doc_id", "size", "text_crc32", "shard", slots.alias("slot"), "home_shard")
