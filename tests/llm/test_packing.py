import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from veilspark.llm import packing, tokens

from .helpers import DOCS, docs

TEXTS = [None, "", "Hello, World!! it's 42% done... Été—ok", "a b\tc\n\n d", "<|endoftext|> is text", "Íö ΣΑΣ İstanbul",
         "word " * 9000, "thea.!! ***x y*** don't 'tis we'll", "x" * 5000, "\x1c a\x85b", "(paren) [br] a.b.c, d;e 日本語 текст",
         "Straße ÄÖÜ ÿ ªº× Œuvre œil Łódź ŉ ǅ e\u0301té. É\u0301 ﬁn A\tB,\rC --- ...! 'S it'S 12a a12 ... .a", "Word\n,x Word.\n\nword"]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))


def reference(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    model = tokens.load("word_bpe_49k")
    for _ in range(2):  # learned, then remembered
        ids, bounds = model.encode(pa.array(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == reference(text), text


def check(pieces, rows, window):
    want = [np.asarray([*reference(t), packing.END], "<u4").tobytes() for _, t in rows]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for (doc_id, _), raw in zip(rows, want):
        own, at = sorted(by_doc[doc_id], key=lambda p: p["start"]), 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(raw) // 4
            assert p["ids_crc32"] == zlib.crc32(raw[4 * at:4 * (at + p["length"])])
            at += p["length"]
        assert at == len(raw) // 4
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return by_seq


def test_pieces_cover_every_id_once(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, "some more words " * (i % 40 + 1)) for i in range(300)]
    for window, most in ((4096, 64), (64, 3)):
        pieces = packing.pack(docs(spark, [(*r, 1) for r in rows], DOCS + ", start int"), window, most).collect()
        by_seq = check(pieces, rows, window)
        used = sum(p["length"] for p in pieces)
        assert used / window <= len(by_seq) <= 1.15 * used / window + 1


def test_leftovers_travel_in_units():
    w = packing.Windows(4096, 64)
    for i in range(5000):
        w.place(1 + i % 3, (i, 0, 1 + i % 3, 0, 1 + i % 3))
    rows, by_unit = packing.open_rows(w.rest(), 7), defaultdict(list)
    for r in rows:
        by_unit[r[-1]].append(r)
    for unit in by_unit.values():
        assert [r[6] for r in unit] == [sum(x[2] for x in unit[:i]) for i in range(len(unit))]
    assert len(rows) > 500 and len(by_unit) <= len(w.rest()) * (4096 // packing.UNIT + 1)


def test_repeats_nulls_and_empty(spark):
    pieces = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])).collect()
    assert sorted((p["doc_id"] or -1, p["length"]) for p in pieces) == [(-1, 1), (-1, 3), (1, 3), (1, 3)]
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == 4
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit_and_fullest():
    w = packing.Windows(10, 2)
    assert w.place(6, ("a",)) == [] and w.place(5, ("b",)) == []
    assert w.place(4, ("c",)) == [(0, [(0, ("a",)), (6, ("c",))])]  # the least room that suffices, now full
    assert w.place(7, ("d",)) == [] and w.place(8, ("e",)) == [(2, [(0, ("d",))])]  # none fits: the fullest goes
    assert w.rest() == [(1, [(0, ("b",))]), (3, [(0, ("e",))])]
