"""Few-shot example search as Spark jobs (K1-K5).

The reference hill-climbs the example list of a prompt against a live model.
No model ships here, so a deterministic *stand-in* scorer answers instead:
after the v4 rule fast path (D4), a case takes the label of its nearest
example by Jaccard overlap of lower-cased word sets; zero overlap, or a tie
at the top that includes a SENSITIVE example, fails safe to SENSITIVE. It
makes the search runnable and checkable; its accuracy is not the model's.

Scale: all lists of a round hold few different examples (at most 12 and one
new one a candidate). Their word sets are constants, so a case finds its overlap
with each example, and from that its answer under each candidate list, inside
one projection; the only shuffle is that of the counts per candidate.
Driver state is the incumbent only (<= 12 examples), one round's candidates
(<= 8 lists) and the examples drawn for all rounds (<= 8 a round, one pass over
the training rows); every scoring pass is a distributed job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.answers import PUBLIC, SENSITIVE
from veilspark.functions.text import word_set
from veilspark.operators import evaluate as E
from veilspark.operators.classify import classify_fast

MAX_EXAMPLES = 12
EXAMPLE_CUT = 150
SWAPS_PER_CLASS = 3
SEED = 42

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("cand_id", T.IntegerType(), False),
    T.StructField("move", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
])


def _h(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def candidate_moves(incumbent: list[tuple[str, str]], rnd: int, seed: int = SEED) -> list[dict]:
    """K1 plan: 3 swaps of a SENSITIVE position, 3 of a PUBLIC one, plus
    add-S / add-P while under the cap. Positions come from a seeded hash;
    replacements are drawn later, on the cluster."""
    moves = []
    for move, lab in (("swap_s", SENSITIVE), ("swap_p", PUBLIC)):
        idx = [i for i, (_, l) in enumerate(incumbent) if l == lab]
        for j in range(SWAPS_PER_CLASS):
            if idx:
                moves.append({"slot": len(moves), "move": move, "label": lab,
                              "pos": idx[_h(seed, rnd, move, j) % len(idx)], "j": j})
    if len(incumbent) < MAX_EXAMPLES:
        moves.append({"slot": len(moves), "move": "add_s", "label": SENSITIVE, "pos": len(incumbent), "j": 0})
        moves.append({"slot": len(moves), "move": "add_p", "label": PUBLIC, "pos": len(incumbent), "j": 0})
    return moves


def slot_hash(case_id, seed: int, rnd: int, move: str, j: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(rnd)), F.lit(move), F.lit(str(j)),
                             case_id.cast("string")))


# (move, label, j): every replacement a round may need
DRAWS = [(move, label, j) for move, label, n in (
    ("swap_s", SENSITIVE, SWAPS_PER_CLASS), ("swap_p", PUBLIC, SWAPS_PER_CLASS),
    ("add_s", SENSITIVE, 1), ("add_p", PUBLIC, 1)) for j in range(n)]


def draw_replacements(train: DataFrame, rounds: list[int], seed: int = SEED) -> dict[tuple[int, str, int], str]:
    """For every (round, move, j) the text of the training row of the wanted
    label with the smallest seeded hash. They depend on nothing else, so one
    pass over the training rows draws for all rounds; at most 8 texts a round
    come to the driver."""
    slots = [(rnd, move, label, j) for rnd in rounds for move, label, j in DRAWS]
    row = train.agg(*[
        F.min(F.when(F.col("label") == label, F.struct(slot_hash(F.col("case_id"), seed, rnd, move, j), "case_id", "text"))
              ).getField("text").alias(f"s{n}") for n, (rnd, move, label, j) in enumerate(slots)]).first()
    return {(rnd, move, j): row[n] for n, (rnd, move, _, j) in enumerate(slots)}


def assemble(incumbent: list[tuple[str, str]], moves: list[dict], repl: dict[int, str]) -> list[dict]:
    """Candidate rows (cand_id, move, pos, text, label) from the drawn replacements."""
    rows = []
    for m in moves:
        text = repl.get(m["slot"])
        if text is None:  # class absent from train: the move is skipped
            continue
        ex = list(incumbent)
        if m["move"].startswith("swap"):
            ex[m["pos"]] = (text, m["label"])
        else:
            ex.append((text, m["label"]))
        rows += [{"cand_id": m["slot"], "move": m["move"], "pos": i, "text": t, "label": l}
                 for i, (t, l) in enumerate(ex)]
    return rows


def candidate_rows(incumbent: list[tuple[str, str]], rnd: int, drawn: dict[tuple[int, str, int], str],
                   seed: int = SEED) -> list[dict]:
    """K1: the rows of one round's candidate lists."""
    moves = candidate_moves(incumbent, rnd, seed)
    return assemble(incumbent, moves, {m["slot"]: drawn.get((rnd, m["move"], m["j"])) for m in moves})


def lists_of(rows: list[dict]) -> dict[int, list[tuple[str, str]]]:
    """Example lists by candidate id."""
    out: dict[int, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: (r["cand_id"], r["pos"])):
        out.setdefault(r["cand_id"], []).append((r["text"], r["label"]))
    return out


def candidates(spark: SparkSession, train: DataFrame, incumbent: list[tuple[str, str]], rnd: int,
               seed: int = SEED) -> DataFrame:
    return spark.createDataFrame(candidate_rows(incumbent, rnd, draw_replacements(train, [rnd], seed), seed), EXAMPLE_SCHEMA)


def example_words(spark: SparkSession, texts: list[str]) -> dict[str, list[str]]:
    """The distinct words of each example as it is shown (its first ``EXAMPLE_CUT``
    characters), for at most the examples of all rounds."""
    told = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string")
    shown = told.select("text", word_set(F.substring("text", 1, EXAMPLE_CUT)).alias("words"))
    return {r["text"]: r["words"] for r in shown.collect()}


def one_literal(words: list[str]) -> Column:
    """Words, which hold no blanks, as one constant array."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def case_words(cases: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``cases`` without their texts, with ``rule_hit``, ``_n`` (the case's distinct
    words) and ``_shared`` (those of them in ``vocabulary``): all that an overlap
    with any example of these words depends on."""
    others = [c for c in cases.columns if c != "text"]
    own = classify_fast(cases, "v4").select(*others, "rule_hit", word_set(F.col("text")).alias("_own"))
    return own.select(*others, "rule_hit", F.size("_own").alias("_n"),
                      F.array_intersect("_own", one_literal(vocabulary)).alias("_shared"))


def nearness(words: Column, sensitive: Column) -> Column:
    """(jac, s) of one example; at equal overlap SENSITIVE is the greater (fail-safe)."""
    both = F.size(F.array_intersect(F.col("_shared"), words))
    share = both.cast("double") / (F.col("_n") + F.size(words) - both).cast("double")
    return F.struct(F.when(both > 0, share).otherwise(F.lit(0.0)).alias("jac"), sensitive.alias("s"))


def answer_of(best: Column) -> Column:
    safe = F.col("rule_hit") | (best["jac"] <= 0) | best["s"]
    return F.when(safe, F.lit(SENSITIVE)).otherwise(F.lit(PUBLIC))


def standin_predict(cases: DataFrame, lists: dict[int, list[tuple[str, str]]]) -> DataFrame:
    """Predictions (case_id, cand_id, label, predicted) of the stand-in for
    every case and example list (``lists`` by candidate id: <= 9 of <= 12)."""
    examples = sorted({e for ex in lists.values() for e in ex})
    number = {e: i for i, e in enumerate(examples)}
    words = example_words(cases.sparkSession, [t for t, _ in examples])
    known = F.array(*[F.struct(one_literal(words[t]).alias("words"), F.lit(label == SENSITIVE).alias("s")) for t, label in examples])
    members = F.array(*[F.struct(F.lit(k).alias("cand_id"), F.array(*[F.lit(number[e]) for e in ex]).alias("of"))
                        for k, ex in sorted(lists.items())])
    met = case_words(cases.select("case_id", "text", "label"), sorted({w for ws in words.values() for w in ws}))
    near = met.select("case_id", "label", "rule_hit", F.transform(known, lambda e: nearness(e["words"], e["s"])).alias("_near"))
    best = near.select("case_id", "label", "rule_hit", F.inline(F.transform(members, lambda m: F.struct(
        m["cand_id"].alias("cand_id"),
        F.array_max(F.transform(m["of"], lambda i: F.get(F.col("_near"), i))).alias("_best")))))
    return best.select("case_id", "cand_id", "label", answer_of(F.col("_best")).alias("predicted"))


def placed(words: Column, sensitive: Column, pos: Column) -> Column:
    near = nearness(words, sensitive)
    return F.struct(near["jac"].alias("jac"), near["s"].alias("s"), pos.alias("pos"))


def two_nearest(rows: Column) -> Column:
    return F.slice(F.sort_array(rows, asc=False), 1, 2)


def of_list(examples: list[tuple[str, str]], words: dict[str, list[str]]) -> Column:
    """The two nearest of a whole list: array of (jac, s, pos), nearest first."""
    known = F.array(*[F.struct(one_literal(words[t]).alias("words"), F.lit(label == SENSITIVE).alias("s"), F.lit(i).alias("pos"))
                      for i, (t, label) in enumerate(examples)])
    return two_nearest(F.transform(known, lambda e: placed(e["words"], e["s"], e["pos"])))


def predict_moves(kept: DataFrame, moves: list[dict], words: dict[str, list[str]]) -> DataFrame:
    """Predictions (case_id, cand_id, label, predicted) for lists that differ from the
    incumbent's in one place. ``kept`` holds ``case_words`` and ``_near``, the two
    nearest of the incumbent's list. The best of the list without one example is
    the first of the two that is not this one, so only the new example is compared:
    the work does not depend on the length of the list. A move without a
    text is the incumbent."""
    told = F.array(*[F.struct(
        F.lit(m["slot"]).alias("cand_id"), F.lit(m["pos"]).alias("pos"),
        one_literal(words[m["text"]] if m["text"] is not None else []).alias("words"),
        F.lit(m["text"] is not None and m["label"] == SENSITIVE).alias("s")) for m in moves])

    def best(m: Column) -> Column:
        left = F.filter("_near", lambda x: x["pos"] != m["pos"])
        return F.array_max(F.concat(left, F.array(placed(m["words"], m["s"], m["pos"]))))

    out = kept.select("case_id", "label", "rule_hit", F.inline(F.transform(told, lambda m: F.struct(
        m["cand_id"].alias("cand_id"), best(m).alias("_best")))))
    return out.select("case_id", "cand_id", "label", answer_of(F.col("_best")).alias("predicted"))


def accept_move(kept: DataFrame, move: dict, examples: list[tuple[str, str]], words: dict[str, list[str]]) -> DataFrame:
    """``kept`` for ``examples``, the list after ``move``. A case that did not have the
    example now gone among its two compares the new one alone; the others compare
    the whole list."""
    left = F.filter("_near", lambda x: x["pos"] != move["pos"])
    new = placed(one_literal(words[move["text"]]), F.lit(move["label"] == SENSITIVE), F.lit(move["pos"]))
    near = F.when(F.size(left) < F.size("_near"), of_list(examples, words)).otherwise(two_nearest(F.concat(left, F.array(new))))
    return kept.withColumn("_near", near)


def score(pred: DataFrame) -> DataFrame:
    """K2 score per candidate: few-shot confusion (F2c) and 2*fnr + fpr."""
    conf = E.confusion(pred.withColumn("latency_ms", F.lit(0.0)), ("cand_id",), "fewshot")
    m = E.metrics(conf)
    return m.select("cand_id", "total", "correct", "false_negatives", "false_positives",
                    "accuracy_pct", "fnr_pct", "fpr_pct",
                    (F.col("fnr_pct") * 2.0 + F.col("fpr_pct")).alias("score"))


def search(spark: SparkSession, cases: DataFrame, seed_examples: list[tuple[str, str]],
           rounds: int = 12, sample_size: int = 100, seed: int = SEED) -> tuple[list[tuple[str, str]], dict, dict]:
    """K3: hill climbing. ``cases`` carries a ``split`` column (train/dev/test).
    Per round: candidates, quick score on a seeded dev sample (the incumbent is
    re-scored on the same sample -- deviation: the reference compares a sample
    score with a full-dev score), verify the best on full dev, accept only if
    strictly better. Returns (examples, dev metrics, test metrics).

    The replacements of all rounds are drawn first, so the words that matter are
    known (at most ``rounds * 8 + MAX_EXAMPLES`` examples of ``EXAMPLE_CUT``
    characters): texts are read once more, and what is landed of a case is its
    words among these and the two nearest examples of the incumbent."""
    from veilspark.operators.cascade import land
    from veilspark.operators.splits import seeded_samples
    numbers = list(range(1, rounds + 1))
    drawn = draw_replacements(cases.where(F.col("split") == "train").select("case_id", "text", "label"), numbers, seed)
    words = example_words(spark, [t for t, _ in seed_examples] + [t for t in drawn.values() if t is not None])
    narrow = case_words(cases.where(F.col("split").isin("dev", "test")).select("case_id", "text", "label", "split"),
                        sorted({w for ws in words.values() for w in ws}))
    narrow = land(narrow.withColumn("_near", of_list(seed_examples, words)), "fewshot-cases")
    dev, test = (narrow.where(F.col("split") == s).drop("split") for s in ("dev", "test"))
    samples = land(seeded_samples(dev, sample_size, numbers, "case_id", seed), "fewshot-samples")
    stays = {"slot": -1, "pos": -1, "text": None, "label": None}

    def one(move, on):
        return score(predict_moves(on, [move], words)).first().asDict()

    best_ex, best = list(seed_examples), one(stays, dev)
    for rnd in numbers:
        moves = [m | {"text": drawn.get((rnd, m["move"], m["j"]))} for m in candidate_moves(best_ex, rnd, seed)]
        moves = {m["slot"]: m for m in moves if m["text"] is not None}
        sample = samples.where(F.col("round") == rnd)
        rows = {r["cand_id"]: r for r in score(predict_moves(sample, [*moves.values(), stays], words)).collect()}  # <= 9 rows
        winner = better(rows)
        if winner is None:
            continue
        full = one(moves[winner], dev)
        if full["score"] < best["score"]:
            best, best_ex = full, lists_of(assemble(best_ex, [moves[winner]], {winner: moves[winner]["text"]}))[winner]
            dev, samples = (land(accept_move(t, moves[winner], best_ex, words), "fewshot-near") for t in (dev, samples))
    return best_ex, best, one(stays, test.withColumn("_near", of_list(best_ex, words)))


def better(rows: dict[int, Row]) -> int | None:
    """The candidate with the least score below the incumbent's (-1), if any."""
    less = [(r["score"], k) for k, r in rows.items() if k >= 0 and -1 in rows and r["score"] < rows[-1]["score"]]
    return min(less)[1] if less else None
