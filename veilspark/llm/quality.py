"""Quality classifier: random Fourier features, ridge regression by normal
equations, isotonic calibration.

Statistics of the whole text (shares of character kinds, word and line
repetition, lengths) are standardised and mapped to ``FEATURES`` random Fourier
features, cosines that approximate a Gaussian kernel. Each partition of the
labelled rows adds up its part of the normal equations; the parts are summed by
row of the matrix in Spark, and the driver solves one system whose size is the
number of features. The ridge scores of rows kept out of the fit are binned,
their labels averaged per bin, and pool-adjacent-violators makes the means
monotone; scores are interpolated between the pools. All labelled rows that are
not held out take part, three quarters in the fit and one in the calibration.

What reaches the driver is bounded by ``FEATURES`` and ``BINS``. Texts are read
in place and never shuffled.

Defined cases: a null or empty text has all statistics 0 and gets the score
such texts deserve; labels that are null, neither 0 nor 1, or contradict each
other for one id teach nothing; a null id has no label and is not held out;
without labels every score is 0.5, with labels of one kind it is their mean;
repeated rows are scored each; extra columns are ignored (``keep_good`` keeps
them); empty tables give empty results.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land

FEATURES = 256
RIDGE = 1e-3
BINS = 2048
SEED = 20
FOLDS = 5
THRESHOLD = 0.3
ROWS_PER_SUM = 20_000
MOST_SUMS = 256

LETTERS = np.array([bytes([b]).isalpha() for b in range(256)])
UPPER = np.array([bytes([b]).isupper() for b in range(256)])
DIGITS = np.array([bytes([b]).isdigit() for b in range(256)])
BLANK = np.array([bytes([b]).isspace() for b in range(256)])
STOPS = np.isin(np.arange(256), list(b".,;:'\"?-()"))
MARKS = np.array([33 <= b < 127 for b in range(256)]) & ~LETTERS & ~DIGITS & ~STOPS
BARS = np.isin(np.arange(256), list(b"|"))
SHOUTS = np.isin(np.arange(256), list(b"!"))
WIDE = np.arange(256) >= 128
KINDS = np.stack([LETTERS, UPPER, DIGITS, BLANK, STOPS, MARKS, BARS, SHOUTS, WIDE]).astype(float)
N_STATS = len(KINDS) + 10


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(N_STATS)
    n = len(text)
    if not n:
        return out
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    shares = KINDS @ seen
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    shares[1] /= max(shares[0], 1e-9)  # upper case among letters
    present = seen[seen > 0]
    out[:len(KINDS)] = shares
    out[len(KINDS):] = (
        np.log1p(n), np.log1p(len(words)), n / k, len(set(words)) / k, len(set(words)) / np.sqrt(k),
        sum(map(operator.eq, words, words[1:])) / k, -(present * np.log2(present)).sum(), len(lines) / k,
        len(set(lines)) / len(lines), seen.max())
    return out


def stats_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()]).reshape(-1, N_STATS)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(text: pa.Array) -> pa.Array:
    return pa.array(list(stats_of(text)), pa.list_(pa.float64()))


@dataclass
class Model:
    """Constant ``mean`` unless fitted; then standardise, map, weigh, calibrate."""
    mean: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS)
        z = np.clip((stats - self.center) / self.scale, -6, 6) @ directions + rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.mean)
        if self.knots is None:
            return np.clip(self.raw(stats), 0, 1)
        return np.interp(self.raw(stats), self.knots, self.levels)


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 4; 0 is held out. Null ids are in none."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = FEATURES + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(np.stack(batch["_stats"].to_numpy()))
            left += z.T @ z
            right += z.T @ batch["_label"].to_numpy(float)
        if left.any():
            yield pd.DataFrame({"i": np.arange(size), "v": list(np.column_stack([left, right]))})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(rows["v"].to_numpy()), axis=0)]})

    summed = rows.mapInPandas(part, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    whole = np.zeros((size, size + 1))
    for row in summed.collect():
        whole[row["i"]] = row["v"]
    return whole[:, :-1], whole[:, -1]


def pool(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: first and last bin of each pool, and its mean."""
    pools: list[list[float]] = []
    for i, (s, n) in enumerate(zip(sums, counts, strict=True)):
        pools.append([s, n, i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, _, last = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += n2
            pools[-1][3] = last
    at = np.array(pools)
    return at[:, 2].astype(int), at[:, 3].astype(int), at[:, 0] / at[:, 1]


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Isotonic levels from rows that the fit has not seen."""
    @F.arrow_udf("int")
    def bin_of(stats: pa.Array) -> pa.Array:
        s = model.raw(stats.flatten().to_numpy().reshape(-1, N_STATS))
        return pa.array(np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32))

    found = rows.groupBy(bin_of("_stats").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("s")).collect()
    if found:
        found.sort(key=lambda r: r["bin"])
        bins = (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5
        first, last, level = pool(np.array([float(r["s"]) for r in found]), np.array([float(r["n"]) for r in found]))
        model.knots, model.levels = np.column_stack([bins[first], bins[last]]).ravel(), np.repeat(level, 2)
    return model


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats(doc_id, _stats)`` and ``labels(doc_id, quality)``. Rows of fold 0
    take no part, fold 4 calibrates, the others fit."""
    told = (labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
            .agg(F.min("quality").alias("_label"), F.max("quality").alias("_other")).where("_label = _other").drop("_other"))
    rows = land(stats.where(fold() != 0).join(told, "doc_id").withColumn("_fold", fold()), "labelled")
    fitting, rest = rows.where(F.col("_fold") != FOLDS - 1), rows.where(F.col("_fold") == FOLDS - 1)
    columns = [F.col("_stats")[i] for i in range(N_STATS)]
    sums = fitting.agg(F.count(F.lit(1)), F.avg("_label"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, mean = sums[0], sums[1]
    if not n or mean in (0.0, 1.0):
        return Model(0.5 if not n else mean)
    model = Model(mean, np.array(sums[2:2 + N_STATS]), np.maximum(np.array(sums[2 + N_STATS:]), 1e-6))
    parts = min(MOST_SUMS, -(-n // ROWS_PER_SUM))
    left, right = normal_equations(fitting.select("_stats", "_label").repartition(parts), model)
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, right)
    return calibrate(model, rest)


def document_statistics(docs: DataFrame) -> DataFrame:
    return land(docs.select("doc_id", text_statistics(F.col("text")).alias("_stats")), "statistics")


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``."""
    stats = document_statistics(docs)
    model = fit(stats, labels)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column.flatten().to_numpy().reshape(-1, N_STATS)))

    out = stats.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), scored("_stats").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns kept."""
    model = fit(document_statistics(docs), labels)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.score(stats_of(text)))

    return docs.where(scored(F.col("text")) >= threshold)
