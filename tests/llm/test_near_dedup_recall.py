"""Recall of near-dedup against all pairs, at similarities around the threshold,
with and without passages that many texts share."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import near_dedup

from .helpers import docs

WORDS = [f"word{i}" for i in range(5000)]


def corpus(seed, shared, bases=180, copies=4):
    """Texts of 150 to 260 words; copies with one to six words replaced, near 0.8. With
    ``shared``, two passages of 60 words stand in a third of the bases each."""
    rng = random.Random(seed)
    prose = lambda n: rng.choices(WORDS, k=n)
    passages, rows = [prose(60), prose(60)], []
    for base in range(bases):
        words = prose(rng.randrange(150, 260))
        if shared and base % 3 < 2:
            words = words[:40] + passages[base % 3] + words[40:]
        rows.append(words)
        for _ in range(copies):
            other = list(words)
            for i in rng.sample(range(len(other)), rng.randrange(1, 7)):
                other[i] = rng.choice(WORDS)
            rows.append(other)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def similar_pairs(rows, least):
    """``{(a, b): similarity}`` of all pairs that reach ``least``, from the definition."""
    grams, holders = [], defaultdict(list)
    for n, (_, text) in enumerate(rows):
        words = text.split()
        grams.append(Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)))
        for g in grams[-1]:
            holders[g].append(n)
    idf = {g: np.log1p(len(rows) / (len(h) + near_dedup.SMOOTHING * len(rows))) for g, h in holders.items()}
    total = [sum(c * idf[g] for g, c in own.items()) for own in grams]
    both = Counter()
    for g, held in holders.items():
        for x, a in enumerate(held):
            for b in held[x + 1:]:
                both[a, b] += idf[g] * min(grams[a][g], grams[b][g])
    found = {p: w / (total[p[0]] + total[p[1]] - w) for p, w in both.items()}
    return {p: s for p, s in found.items() if s >= least}


def missed(spark, rows, least):
    """Pairs that reach ``least``, and those of them in different classes."""
    pairs = similar_pairs(rows, least)
    named = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(spark, rows)).collect()}
    return pairs, {p: s for p, s in pairs.items() if named[p[0]] != named[p[1]]}, named


@pytest.mark.parametrize("shared", [False, True])
def test_recall_against_all_pairs(spark, shared):
    rows = corpus(3, shared)
    pairs, lost, named = missed(spark, rows, near_dedup.SIMILAR + 1e-6)
    close = [p for p, s in pairs.items() if s < 0.9]
    print(f"shared {shared}: {len(pairs)} pairs, {len(close)} under 0.9, missed {sorted(lost.values())}")
    assert len(close) > 300
    assert sum(p in lost for p in close) <= 0.02 * len(close) and len(lost) <= 0.02 * len(pairs)
    for a in range(len(rows)):  # nothing beyond brute force: classes stay within a base and its copies
        assert named[a] // 5 == a // 5
