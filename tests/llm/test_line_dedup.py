import hashlib
import re
from collections import defaultdict

from veilspark.llm import line_dedup

from .helpers import DOCS, docs

LONG = "This line is long enough to count"
ROWS = [
    (1, f"{LONG}\nown one\n{LONG.upper()}\nÉcole is a word with an accent, long"), (2, f"  {LONG}\t\nshort\nshort"),
    (3, f"a\n{LONG}\n\n{LONG}"), (4, None), (5, ""), (6, "short"), (7, "short\n"), (8, "short\nécole is a word with an accent, long"),
    (9, "École is a word with an accent, long"), (10, "École is a word with an accent, LONG"),
    (11, "repeated inside one document only\n" * 5), (12, "\x0b" + "only two documents have this line"),
    (13, "only two documents have this line"), (14, "x" * 100_000 + "\n" + "\n".join(f"line number {i} of a long text" for i in range(2000))),
]


def brute(rows):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(line_dedup.BLANKS))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_against_brute_force(spark):
    got = {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, ROWS)).collect()}
    assert got == brute(ROWS)
    assert got[3][2] == 0 and got[1][2] == 2 + 1


def test_nulls_repeats_clashes_and_empty(spark):
    table = docs(spark, [(i, t, 7, "x") for i, t in ROWS[:3]] + [(1, ROWS[0][1], 7, "x"), (None, LONG, 7, "y")], DOCS + ", n_lines int, lang string")
    got = line_dedup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 5 and [r["n_dropped"] for r in rows if r["doc_id"] == 1] == [2, 2]
    assert [(r["text"], r["n_lines"]) for r in rows if r["doc_id"] is None] == [("", 1)]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert line_dedup.dedup_lines(docs(spark, [(4, None)])).first()["text"] is None


def test_query_digest(spark):
    from veilspark.llm.queries import op10_line_dedup
    r = op10_line_dedup(spark, "/root/testdata/sf0.001").first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
