import random

import pytest

from veilspark.operators.leakage import contained_passages

ALPHABET = ["a", "b", "ä", "日", " ", ".", "_", "1", "\n", "𝄞"]


def held(texts, passages):
    return sorted((i, j) for i, t in texts for j, p in passages if t is not None and p and p in t)


def found(spark, texts, passages, **how):
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    p = spark.createDataFrame(passages, "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in contained_passages(t, p, **how).collect())


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_equals_contains(spark, limit):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice(ALPHABET) for _ in range(n))
    texts = [(i, word(draw.randint(0, 80))) for i in range(60)] + [(100, None), (101, ""), (102, "one two three four five six seven eight nine ten eleven"), (103, "x" * 50_000 + "needle in")]
    passages = [(i, word(draw.randint(1, 5))) for i in range(40)] + [(200 + i, texts[i][1][draw.randint(0, 9):draw.randint(10, 60)]) for i in range(40)]
    passages += [(300 + n, " ".join("one two three four five six seven eight nine ten eleven".split()[:n])) for n in range(1, 12)]
    passages += [(400, None), (401, ""), (402, "wo thre"), (403, "xneedle in"), (404, "xx"), (404, "xx"), (405, "𝄞"), (406, "日ä"), (407, ".")]
    assert found(spark, texts, passages, broadcast_limit=limit) == held(texts, sorted(set(passages), key=str))
    assert len(held(texts, passages)) > 300


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []


def test_plan_does_not_depend_on_lengths(spark):
    texts = spark.createDataFrame([(1, "some text")], "doc_id long, text string")

    def plan(lengths):
        p = spark.createDataFrame([(n, "x" * n) for n in lengths], "item_id long, text string")
        return contained_passages(texts, p)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan([1, 2, 9]).splitlines()) == len(plan(range(1, 40)).splitlines())
    assert "Union" not in plan([1, 5])
