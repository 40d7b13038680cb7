"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of about ``BLOCK`` rows and queries into blocks of
``QUERY_BLOCK``; every query block meets every candidate block once. In a block
each dimension has a list sorted by value. A query reads its lists in step, from
the top where its component is positive and from the bottom where it is
negative, scores the rows it meets for the first time, and keeps the k best.
The sum over dimensions of component times last value read bounds every row not
met yet; reading stops when that bound is below the kth score. (At equality a
smaller id might still follow, so reading goes on.) The blocks' k best of each
query are merged, which is exact since the true k best are among them.

Components become floor(``scale`` * x) as 64-bit integers.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; rows that repeat id and vector are one
row; every row with the query's id counts as its own; vectors of different
length are compared as if the shorter ended in zeros; with fewer than k
candidates all are returned; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land

SCALE = 256
BLOCK = 8192
QUERY_BLOCK = 1024
DEPTH = 64

FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, _v``: whole vectors as integers, each once."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("_v")).distinct()


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class Lists:
    """Rows of one block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.up, axis=0)

    def best(self, own: int, query: np.ndarray, k: int, depth: int = DEPTH) -> list[tuple[int, int]]:
        """(score, id) of the k best, ties to the smaller id."""
        n, used = len(self.ids), np.flatnonzero(query)
        weights, descending = query[used], query[used] > 0
        met = np.zeros(n, bool)
        top_ids, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        read = 0
        while read < n:
            stop = min(n, read + depth)
            if len(used):
                at = np.arange(read, stop)[:, None]
                at = np.where(descending, n - 1 - at, at)
                fresh = np.zeros(n, bool)
                fresh[self.up[at, used]] = True
                new = np.flatnonzero(fresh & ~met)
            else:  # every row scores 0
                new, stop = np.arange(n), n
            met[new] = True
            new = new[self.ids[new] != own]
            scores = self.rows[new] @ query
            ids, scores = np.concatenate([top_ids, self.ids[new]]), np.concatenate([top_scores, scores])
            keep = np.lexsort((ids, -scores))[:k]
            top_ids, top_scores, read = ids[keep], scores[keep], stop
            if read < n and len(top_ids) == k:
                last = self.values[np.where(descending, n - read, read - 1), used]
                if int(weights @ last) < top_scores[-1]:
                    break
        return list(zip(top_scores.tolist(), top_ids.tolist(), strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows for each row that ``is_query`` names: ``query_id, rank,
    vec_id, score``."""
    rows = land(usable(vectors, scale), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))

    def deal(part: DataFrame, own: int, name: str, others: int, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        dealt = part.withColumn(name, F.pmod(F.xxhash64("vec_id", "_v"), F.lit(own)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def meet(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ours) and len(theirs):
            width = max(max(map(len, ours["_v"])), max(map(len, theirs["_v"])), 1)
            lists = Lists(ours["vec_id"].to_numpy(), matrix(ours["_v"], width))
            for own, query in zip(theirs["vec_id"].tolist(), matrix(theirs["_v"], width), strict=True):
                out += [(own, vec_id, score) for score, vec_id in lists.best(own, query, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    left = deal(rows, blocks, "_block", query_blocks, "_queries")
    right = deal(queries, query_blocks, "_queries", blocks, "_block")
    found = left.groupBy("_block", "_queries").cogroup(right.groupBy("_block", "_queries")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
