"""Random substitutions against the brute force over all diagonals; short items, runs and pieces."""

import random

from veilspark.llm import decontaminate

from .helpers import docs
from .test_decontaminate import WORDS, bench, brute


def test_every_substitution_pattern_is_found(spark):
    rng = random.Random(17)
    words = lambda n: rng.choices(WORDS, k=n)
    items = [(n, " ".join(words(n))) for n in (10, 11, 12, 13, 15, 21, 38, 59)]
    rows = [(1, " ".join([*words(20), *("zzz" if p not in (0, 1, 5, 6, 10, 11) else w for p, w in enumerate(items[2][1].split())), *words(20)]))]
    for rate in (0.1, 0.2, 0.25, 0.4, 0.5):
        for _ in range(30):
            for _, text in items:
                copy = [rng.choice(WORDS) if rng.random() < rate else w for w in text.split()]
                rows.append((len(rows) + 1, " ".join(words(rng.randrange(9)) + copy + words(rng.randrange(9)))))
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.find_leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert set(got) == brute(rows, items) and got[1, 12] == 6


def test_short_items_runs_and_pieces(spark):
    rng = random.Random(23)
    words = lambda n: rng.choices(WORDS, k=n)
    long, middle = words(59), words(39)
    items = [(1, " ".join(long)), (2, " ".join(middle)), (3, "What is Q8x?"), (4, "東京はどこですか"), (5, "solo9"), (6, " ".join(["rep1", "rep2", "rep3", "rep4", "rep5"] * 4))]
    rows = [
        (1, " ".join(words(9) + long[20:49] + words(9))), (2, " ".join(words(9) + long[20:33] + words(9))), (3, " ".join(words(9) + long[20:32] + words(9))),
        (4, " ".join(words(5) + middle[:12] + ["put"] + middle[12:24] + ["put", "in"] + middle[24:36] + words(5))),
        (5, "before, what IS q8x after"), (6, "what is not q8x"), (7, "問題東京はどこですか答え"), (8, "a solo9 b solo9"), (9, "solo99"),
        (10, "rep1 rep2 rep3 rep4 rep5"), (11, " ".join(middle[:12] + words(200) + middle[12:24])),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["first_token"]) for r in decontaminate.find_leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(1, 1): (29, 9), (2, 1): (13, 9), (4, 2): (36, 5), (5, 3): (3, 1), (7, 4): (8, 2), (8, 5): (1, 1)}
