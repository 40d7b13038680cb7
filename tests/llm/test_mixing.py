import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilspark.llm import mixing
from veilspark.sources.tables import table

from ..conftest import SF

DOCS = "doc_id long, text string, source string, size string"


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, fixed = {}, {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return target
        fixed |= {s: 3 * sizes[s] for s in above}


def check(rows, docs):
    """``docs``: (doc_id, text, source); ``rows``: the result."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    want = plain_targets(dict(sizes))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((i, size(t), s) for i, t, s in docs)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * (1 + want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix_documents(docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert any(r["taken"] > r["size"] for r in rows) and any(r["taken"] == 0 < r["size"] for r in rows)


def test_nulls_repeats_ties_long(spark):
    docs = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", None), (None, None, None), (2, "", "zero"), (3, None, "zero"),
            (4, "w " * 20000, "big"), (5, "a\x0bb\xa0c", ""), (6, "one", "é")] + [(7, "same text", "hot")] * 3000
    rows = mixing.mix_documents(spark.createDataFrame([(*d, "clash") for d in docs], DOCS)).collect()
    check(rows, docs)
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0


def best(patterns, quotas):
    """Greatest total, then least cost, by trying every flow."""
    edges = [(p, s) for p in patterns for s in p]
    found = (-1, 0)
    for f in itertools.product(*[range(min(3 * patterns[p], quotas[s]) + 1) for p, s in edges]):
        used, into = Counter(), Counter()
        for (p, s), x in zip(edges, f):
            used[p] += x
            into[s] += x
        if all(used[p] <= 3 * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            cost = sum(max(0, used[p] - patterns[p]) + max(0, used[p] - 2 * patterns[p]) for p in patterns)
            found = max(found, (sum(f), -cost))
    return found


def test_flow_is_greatest_and_cheapest():
    draw = random.Random(3)
    for _ in range(40):
        some = draw.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)
        patterns = {p: draw.randint(0, 2) for p in some}
        quotas = {s: draw.randint(0, 4) for s in {s for p in some for s in p}}
        sent = mixing.flow(patterns, quotas)
        used = {p: sum(own.values()) for p, own in sent.items()}
        into = Counter()
        for own in sent.values():
            for s, x in own.items():
                assert x >= 0
                into[s] += x
        assert all(into[s] <= quotas[s] for s in quotas) and all(used[p] <= 3 * patterns[p] for p in patterns)
        cost = sum(max(0, used[p] - patterns[p]) + max(0, used[p] - 2 * patterns[p]) for p in patterns)
        assert (sum(used.values()), -cost) == best(patterns, quotas), (patterns, quotas, sent)


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 5), [["a"], ["a", "b"], ["b", "a", "c"], ["c"], []][i % 5 if i % 7 else 1]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    got = mixing.mix(docs, F.col("tags")).collect()
    assert len(got) == sum(bool(t) for _, _, t in rows)
    sizes = Counter()
    for _, text, tags in rows:
        for t in tags:
            sizes[t] += len(text.split())
    want, into = mixing.targets(dict(sizes)), Counter()
    for r in got:
        assert r["taken"] == sum(p["words"] for p in r["parts"]) <= 3 * r["size"]
        for p in r["parts"]:
            assert p["source"] in r["pattern"]
            into[p["source"]] += p["words"]
    assert all(abs(into[s] - float(want[s])) <= 1 for s in want)
