import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import near_dedup

from .helpers import DOCS, docs

random.seed(11)
WORDS = [f"word{i}" for i in range(3000)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def edited(text, n):
    words = text.split()
    for i in random.sample(range(len(words)), n):
        words[i] = random.choice(WORDS)
    return " ".join(words)


BASES = [prose(300) for _ in range(6)]
PASSAGE = prose(60)
ROWS = [(i, b) for i, b in enumerate(BASES)]
ROWS += [(10 + i, edited(BASES[0], 2)) for i in range(8)] + [(20, edited(BASES[1], 3)), (21, edited(BASES[2], 40))]
ROWS += [(30 + i, prose(100) + " " + PASSAGE + " " + prose(100)) for i in range(40)]
ROWS += [(80, BASES[3]), (81, BASES[3].upper()), (82, None), (83, ""), (84, " \n "), (85, "a b"), (86, "a  b"), (87, "a b c"), (88, prose(20_000)), (89, None)]
ROWS += [(90, ROWS[-2][1] + " more")]


def find(up, i):
    while up[i] != i:
        i = up[i]
    return i


def brute(rows, similar=0.8):
    """All pairs, with the sketch's weights computed from the definition."""
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    grams, df = {}, Counter()
    for t, ids in texts.items():
        words = t.lower().split()
        grams[t] = Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
        for g in grams[t]:
            df[g] += len(ids)
    idf = {g: np.log1p(len(rows) / (n + near_dedup.SMOOTHING * len(rows))) for g, n in df.items()}
    keys, up = list(texts), {t: t for t in texts}
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = sum(min(n, grams[b][g]) * idf[g] for g, n in grams[a].items())
            total = sum(n * idf[g] for t in (a, b) for g, n in grams[t].items())
            if both and both >= similar * (total - both):
                up[find(up, a)] = find(up, b)
    names = {}
    for t in keys:
        for d in texts[t]:
            names.setdefault(find(up, t), []).append(d)
    return {d: min(ds) for ds in names.values() for d in ds}


def test_classes_equal_brute_force(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(spark, [(*r, 1) for r in ROWS], DOCS + ", label int")).collect()}
    assert got == brute(ROWS)
    assert got[10] == 0 and got[20] == 1 and got[21] == 21 and got[80] == got[81] == 3 and got[31] == 31 and got[90] == 88 and got[86] == 85


def test_one_row_of_a_class_stays(spark):
    table = docs(spark, [(*r, "s") for r in ROWS] + [(0, BASES[0], "s")] * 3 + [(None, BASES[4], "s"), (5, "other text of this id, alone", "s")], DOCS + ", samples string")
    kept = near_dedup.keep_one(table)
    assert kept.columns == ["doc_id", "text", "samples"]
    want = sorted(set(brute(ROWS).values()) | {5}) + [5]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert near_dedup.keep_one(docs(spark, [])).count() == 0
    assert near_dedup.classes(docs(spark, [(None, "x y z"), (None, "x y z"), (None, None)])).count() == 3


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(spark, ROWS)).collect()}
    assert got == brute(ROWS)


def test_samples_agree_as_weighted_jaccard(monkeypatch):
    monkeypatch.setattr(near_dedup, "SAMPLES", 3000)
    rng = np.random.default_rng(5)
    shingle = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    a, b = rng.uniform(0.5, 6, 300), rng.uniform(0.5, 6, 300)
    a[:60], b[240:] = 0, 0
    texts = np.concatenate([np.zeros(240, int), np.ones(240, int)])
    drawn = near_dedup.sample(texts, np.concatenate([shingle[60:], shingle[:240]]), np.concatenate([a[60:], b[:240]]), 2)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert np.mean(drawn[0] == drawn[1]) == pytest.approx(want, abs=0.04)


def test_shingles_and_counts():
    texts, shingle, counts = near_dedup.shingles(pa.array([[1, 2, 3, 4, 5, 6], [], None, [7, 8], [9] * 9], pa.list_(pa.int64())))
    assert Counter(texts.tolist()) == {0: 2, 3: 1, 4: 1} and counts.tolist() == [1, 1, 1, 5]


def test_components_of_random_graphs(spark):
    pairs = [(f"{random.randrange(400):03d}", f"{random.randrange(400):03d}") for _ in range(250)] + [(f"{i + 500}", f"{i + 501}") for i in range(90)]
    up = {x: x for p in pairs for x in p}
    for a, b in pairs:
        a, b = find(up, a), find(up, b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in near_dedup.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(up, x) for x in linked}
