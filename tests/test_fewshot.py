"""The example search against a plain twin, and splits by cut keys."""

import hashlib
import re

from pyspark.sql import functions as F

from veilspark.operators import fewshot as FS
from veilspark.operators import splits as S

NOUNS = ["tax", "dog", "river", "loan", "doctor", "garden", "train", "novel"]
SEED_LIST = [("the number", "SENSITIVE"), ("my river", "PUBLIC")]


def rows():
    out = []
    for i in range(90):
        label = "SENSITIVE" if i % 3 == 0 else "PUBLIC"
        text = f"{'my' if label == 'SENSITIVE' else 'the'} {NOUNS[i % 8]} and {NOUNS[i * 5 % 7]} number {i}"
        out.append((i, text, label, ["train", "dev", "dev", "test"][i * 7 % 4]))
    return out


def words(t):
    return {w for w in re.split(r"[^\w]+", t.lower()) if w}


def predicted(text, ex):
    best = (0.0, True)
    for t, label in ex:
        both = len(words(text) & words(t[:150]))
        best = max(best, (both / len(words(text) | words(t[:150])) if both else 0.0, label == "SENSITIVE"))
    return "PUBLIC" if best[0] > 0 and not best[1] else "SENSITIVE"


def scored(cases, ex):
    def share(label):
        own = [c for c in cases if c[2] == label]
        bad = sum(predicted(c[1], ex) != label for c in own)
        return (bad * 2000 + len(own)) // (len(own) * 2) / 10 if own else 0.0
    return 2 * share("SENSITIVE") + share("PUBLIC")


def order(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def twin(cases, ex, rounds, sample_size):
    train, dev, test = ([c for c in cases if c[3] == s] for s in ("train", "dev", "test"))
    ex, best = list(ex), scored(dev, ex)
    for rnd in range(1, rounds + 1):
        moves = FS.candidate_moves(ex, rnd)
        drawn = {m["slot"]: min((c for c in train if c[2] == m["label"]),
                                key=lambda c: order(FS.SEED, rnd, m["move"], m["j"], c[0]))[1] for m in moves}
        lists = FS.lists_of(FS.assemble(ex, moves, drawn))
        sample = sorted(dev, key=lambda c: order(FS.SEED, rnd, c[0]))[:sample_size]
        bar = scored(sample, ex)
        less = [(scored(sample, x), k) for k, x in lists.items() if scored(sample, x) < bar]
        if less and scored(dev, lists[min(less)[1]]) < best:
            ex = lists[min(less)[1]]
            best = scored(dev, ex)
    return ex, best, scored(test, ex)


def test_search_equals_its_twin(spark):
    df = spark.createDataFrame(rows(), "case_id long, text string, label string, split string")
    ex, dev, test = FS.search(spark, df, SEED_LIST, rounds=12, sample_size=25)
    want = twin(rows(), SEED_LIST, 12, 25)
    assert ex == want[0] and ex != SEED_LIST
    assert (dev["score"], test["score"]) == want[1:]


def test_scoring_does_not_shuffle_cases(spark):
    df = spark.createDataFrame(rows(), "case_id long, text string, label string, split string")
    plan = FS.standin_predict(df, {0: SEED_LIST})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_splits_by_cut_keys_are_those_by_rank(spark):
    for n in (0, 1, 2, 7, 500):
        df = spark.range(n).withColumnRenamed("id", "case_id")
        for by_rank, by_key in ((S.split_train_dev_test, S.label_train_dev_test), (S.split_holdout, S.label_holdout)):
            want = {r["case_id"]: r["split"] for r in by_rank(df).collect()}
            assert {r["case_id"]: r["split"] for r in by_key(df).collect()} == want
    text = spark.range(500).select(F.col("id").alias("case_id"), F.lit("text").alias("text"))
    assert "RoundRobin" not in S.label_holdout(text)._jdf.queryExecution().executedPlan().toString()


def test_two_kept_examples_answer_as_whole_lists(spark):
    cases = spark.createDataFrame([*rows(), (900, None, "PUBLIC", "dev"), (901, "", "PUBLIC", "dev"), (902, "call a@b.org", "PUBLIC", "dev")],
                                  "case_id long, text string, label string, split string").select("case_id", "text", "label")
    pool = [(f"{a} {n}", label) for a, label in (("my", "SENSITIVE"), ("the", "PUBLIC"), ("", "PUBLIC")) for n in NOUNS] + [("", "SENSITIVE")]
    words = FS.example_words(spark, [t for t, _ in pool])
    ex = [pool[0], pool[9], pool[9]]
    kept = FS.case_words(cases, sorted({w for ws in words.values() for w in ws})).withColumn("_near", FS.of_list(ex, words))
    assert "text" not in kept.columns
    for n, (text, label) in enumerate(pool[::3]):
        moves = [{"slot": p, "pos": p, "text": text, "label": label} for p in range(len(ex) + 1)]
        lists = {p: ex[:p] + [(text, label)] + ex[p + 1:] for p in range(len(ex) + 1)}
        got, want = ({tuple(r) for r in df.select("case_id", "cand_id", "predicted").collect()}
                     for df in (FS.predict_moves(kept, moves, words), FS.standin_predict(cases, lists)))
        assert got == want
        move = moves[n % len(moves)]
        ex = lists[move["slot"]]
        kept = FS.accept_move(kept, move, ex, words)
        if n % 4 == 3:  # lineage of a test; the search lands these
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        fresh = {r["case_id"]: [(x["jac"], x["s"]) for x in r["_near"]] for r in kept.withColumn("_near", FS.of_list(ex, words)).collect()}
        assert {r["case_id"]: [(x["jac"], x["s"]) for x in r["_near"]] for r in kept.collect()} == fresh


def test_a_move_compares_the_new_example_alone(spark):
    cases = spark.createDataFrame(rows(), "case_id long, text string, label string, split string").drop("split")
    words = {f"example {i}": ["example", f"only{i}"] for i in range(12)} | {"new one": ["brandnew"]}
    ex = [(t, "PUBLIC") for t in words if t != "new one"]
    kept = FS.case_words(cases, ["example", "brandnew"]).withColumn("_near", FS.of_list(ex, words))
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    plan = FS.predict_moves(kept, [{"slot": 0, "pos": 3, "text": "new one", "label": "PUBLIC"}], words)._jdf.queryExecution().optimizedPlan().toString()
    assert "brandnew" in plan and "only" not in plan and "Join" not in plan
