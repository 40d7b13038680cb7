"""The classifier against a plain twin: statistics, features, one solve and the
isotonic levels from their definitions, without Spark."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import quality

from .helpers import DOCS, docs
from .test_quality import LABELS, bad, good

STOPS = ".,;:'\"?-()"


def plain_statistics(text):
    data = [chr(b) for b in (text or "").encode()]  # a byte each
    n = len(data)
    if not n:
        return [0.0] * quality.N_STATS
    ascii_ = lambda c: ord(c) < 128
    share = lambda test: sum(map(test, data)) / n
    letters = share(lambda c: ascii_(c) and c.isalpha())
    words, lines = text.encode().split(), text.encode().split(b"\n")
    k, counts = max(1, len(words)), Counter(data)
    return [
        letters, share(lambda c: "A" <= c <= "Z") / max(letters, 1e-9), share(lambda c: "0" <= c <= "9"), share(lambda c: c in " \t\n\r\v\f"),
        share(lambda c: c in STOPS), share(lambda c: "!" <= c <= "~" and not c.isalnum() and c not in STOPS), share(lambda c: c == "|"),
        share(lambda c: c == "!"), share(lambda c: not ascii_(c)),
        math.log(n + 1), math.log(len(words) + 1), n / k, len(set(words)) / k, len(set(words)) / math.sqrt(k),
        sum(a == b for a, b in zip(words, words[1:])) / k, -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(lines) / k, len(set(lines)) / len(lines), max(counts.values()) / n]


def isotonic(means, counts):
    """Levels by the max-min formula."""
    sums = np.concatenate([[0.0], np.cumsum(means * counts)])
    sizes = np.concatenate([[0.0], np.cumsum(counts)])
    n = len(means)
    mean = lambda j, k: (sums[k + 1] - sums[j]) / (sizes[k + 1] - sizes[j])
    return np.array([max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


def twin(rows, labels):
    told = {}
    for d, q in labels:
        told.setdefault(d, set()).add(q)
    told = {d: q.pop() for d, q in told.items() if len(q) == 1}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    stats = np.array([plain_statistics(t) for _, t in rows])
    fit = [i for i, (d, _) in enumerate(rows) if d in told and fold(d) in (1, 2, 3)]
    rest = [i for i, (d, _) in enumerate(rows) if d in told and fold(d) == 4]
    y = np.array([told.get(d, 0) for d, _ in rows], float)
    center, scale = stats[fit].mean(axis=0), np.maximum(stats[fit].std(axis=0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    directions = rng.normal(size=(quality.N_STATS, quality.FEATURES)) / math.sqrt(quality.N_STATS)
    phases = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((stats - center) / scale, -6, 6) @ directions + phases
    z = np.column_stack([np.cos(z) * math.sqrt(2 / quality.FEATURES), np.ones(len(rows))])
    penalty = quality.RIDGE * len(fit) / quality.FEATURES
    # ridge as least squares with rows of its own for the penalty: no normal equations
    tall = np.vstack([z[fit], math.sqrt(penalty) * np.eye(quality.FEATURES + 1)])
    raw = z @ np.linalg.lstsq(tall, np.concatenate([y[fit], np.zeros(quality.FEATURES + 1)]), rcond=None)[0]
    bins = np.clip(((raw[rest] + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(bins)
    counts = np.array([(bins == b).sum() for b in used])
    means = np.array([y[rest][bins == b].mean() for b in used])
    return np.interp(raw, (used + 0.5) / quality.BINS * 2 - 0.5, isotonic(means, counts))


def noisy_rows(n=500):
    rows = [(i, good(20 + i % 90) if i % 4 else bad(20 + i % 60)) for i in range(n)]
    rows += [(n, ""), (n + 1, None), (n + 2, "Ünï ñ 漢字 " * 30), (n + 3, "! | ? \n\n" * 9)]
    return rows, [(i, int(bool(i % 4)) if i % 11 else int(not i % 4)) for i in range(n) if i % 3] + [(4, 0), (4, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_scores_equal_a_plain_twin(spark, parts):
    rows, labels = noisy_rows()
    got = quality.score(docs(spark, rows, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS).repartition(parts)).collect()
    want = dict(zip([d for d, _ in rows], twin(rows, labels), strict=True))
    assert len({round(v, 3) for v in want.values()}) > 5
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-6 and len(got) == len(rows)
