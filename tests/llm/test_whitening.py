import numpy as np
import pytest

from veilspark.llm import whitening
from veilspark.sources.tables import table

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def reference(vectors, components=32):
    """By integers of any size: every covariance centred before multiplying."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    c = np.array([[n * r[i] - s[i] for i in range(d)] for r in x], object)
    cov = (c.T @ c).astype(object)
    v = np.array([[cov[i, j] / n**3 for j in range(d)] for i in range(d)], float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [int(t) for t in (c * c).sum(axis=1)], c.astype(float) / n @ u / np.sqrt(e), e / np.trace(v)


def test_equals_brute_force(spark):
    rows = table(spark, SF, "embeddings")
    got = whitening.whitened(rows.repartition(3)).collect()
    data = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    ids = sorted(data)
    n, deviation, white, explained = reference([data[i] for i in ids])
    at = {v: k for k, v in enumerate(ids)}
    assert len(got) == len(ids) * 32 and {r["n"] for r in got} == {n}
    own = np.zeros_like(white)
    for r in got:
        own[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    own *= np.sign((own * white).sum(axis=0))
    assert np.abs(own - white).max() < 1e-7
    cov = np.cov(own.T, bias=True) - np.eye(32)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(cov).max(), abs=1e-10) and np.abs(cov).max() < 1e-4


def test_bad_rows_ties_and_large_values(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.5, 3e6], 0), (1, [1.0, 0.5, 3e6], 0), (None, [2.0, -0.25, -7e9], 1), (4, [0.0, 9.0, 1e4], None)]
    bad = [(5, None, 0), (6, [1.0, None, 2.0], 0), (7, [nan, 0.0, 0.0], 0), (8, [0.0, inf, 0.0], 0), (9, [], 0), (10, [1.0], 0)]
    got = whitening.whitened(spark.createDataFrame(good + bad, SCHEMA)).collect()
    n, deviation, white, explained = reference([v for _, v, _ in good], 3)
    assert {r["n"] for r in got} == {4} and {r["vec_id"] for r in got} == {1, None, 4}
    first = [r for r in got if r["component"] == 1]
    assert len(first) == 4
    fits = [d if d < 2**63 else None for d in deviation]
    assert sorted((r["deviation"] for r in first), key=str) == sorted(fits, key=str)
    assert first[0]["explained"] == pytest.approx(explained[0], rel=1e-9)


def test_flat_and_empty(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [1.5, 0.5], 0)], SCHEMA).withColumn("n", whitening.F.lit("x"))).collect()
    assert [(r["component"], abs(r["whitened"]), r["explained"], r["deviation"]) for r in got] == [(1, 1.0, 1.0, 64 * 64)] * 2


def test_centred_beyond_64_bits():
    fitted = whitening.Fit(1 << 30, [(1 << 30) * 1000005, (1 << 30) * 999998], np.ones(1), np.ones((2, 1)), 1.0)
    assert whitening.centred(np.array([[7, 1 << 40]]), fitted).tolist() == [[(1 << 30) * 2, (1 << 70) + (1 << 31)]]
