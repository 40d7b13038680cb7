import random

from veilspark.llm import decontaminate

from .helpers import DOCS, docs

random.seed(3)
WORDS = [f"w{i}" for i in range(400)]
ITEMS = [" ".join(random.choices(WORDS, k=n)) for n in (14, 30, 50)]


def around(middle):
    return " ".join(random.choices(WORDS, k=60)) + " " + middle + " " + " ".join(random.choices(WORDS, k=60))


def substituted(text, every):
    return " ".join("zzz" if i % every == every - 1 else w for i, w in enumerate(text.split()))


ROWS = [
    (1, around(ITEMS[0])), (2, around(ITEMS[1].upper().replace(" ", ", "))), (3, around(substituted(ITEMS[2], 7))),
    (4, around("")), (5, None), (6, ""), (7, ITEMS[0] + " " + ITEMS[1]), (8, around(" ".join(ITEMS[2].split()[:12]))),
    (9, around(" ".join(reversed(ITEMS[1].split())))), (10, "w1 w2"), (11, (around(ITEMS[2]) + " ") * 40),
]
BENCH = [(i, t) for i, t in enumerate(ITEMS)] + [(7, "too short"), (8, None), (9, "")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, items, least=0.5):
    """Every diagonal of every pair, by comparing all positions."""
    out, words = set(), lambda t: [w for w in __import__("re").split(r"[\W_]+", (t or "").lower()) if w]
    for d, t in rows:
        a = words(t)
        for i, u in items:
            b = words(u)
            if len(b) < decontaminate.SPAN:
                continue
            for shift in range(-len(b), len(a)):
                same = sum(a[shift + k] == b[k] for k in range(len(b)) if 0 <= shift + k < len(a))
                if same >= least * len(b):
                    out.add((d, i))
    return out


def test_planted_and_clean(spark):
    got = decontaminate.find_leaks(docs(spark, ROWS), bench(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(ROWS, BENCH) == {(1, 0), (2, 1), (3, 2), (7, 0), (7, 1), (11, 2)}
    by = {(r["doc_id"], r["item_id"]): r for r in got}
    assert by[1, 0]["matched"] == 14 and by[1, 0]["first_token"] == 60 and by[7, 1]["first_token"] == 14
    assert by[3, 2]["overlap"] >= 0.8 and by[11, 2]["first_token"] == 60


def test_filter_keeps_columns_and_clean_rows(spark):
    table = docs(spark, [(d, t, "q") for d, t in ROWS] + [(None, ROWS[0][1], "q"), (1, "clean text with the same id", "q")], DOCS + ", matched string")
    kept = decontaminate.without_leaks(table, bench(spark))
    assert kept.columns == ["doc_id", "text", "matched"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 8, 9, 10]


def test_empty_tables_and_repeats(spark):
    assert decontaminate.find_leaks(docs(spark, []), bench(spark)).count() == 0
    assert decontaminate.find_leaks(docs(spark, ROWS), bench(spark, [])).count() == 0
    twice = decontaminate.find_leaks(docs(spark, [ROWS[0]] * 3), bench(spark, BENCH * 2)).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in twice] == [(1, 0, 14)]


def test_no_python_in_plan(spark):
    plan = decontaminate.find_leaks(docs(spark, ROWS[:1]).union(spark.createDataFrame([], DOCS)), bench(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in text and "ArrowEval" not in text and "BatchEvalPython" not in text
