"""Token ids and counts of whole texts, inside tasks, by public tokenizers.

``WordBpe`` gives exactly the ids of ``word_bpe_49k.json`` with none added; the
names of its special tokens are one id where a text holds them. That tokenizer
drops white space and never joins across it, so a text's ids are those of its
space-separated pieces in order, and each different word of a slice is encoded
once. Lower-case words and the punctuation after them are separate words to the
tokenizer too; every other piece goes through it as it is and is remembered (up
to a bound, then the memory starts anew).
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose lower case is one letter of the same kind and that no normal form changes, then punctuation.
LATIN = r'^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#$%&*,.:;?|\-"()]*)$'
REMEMBER = 300_000
SLICE_BYTES = 4 << 20


def vocabulary(name: str, folder: str | None = None) -> str:
    """A vocabulary file's place: ``folder``, or the installed public files."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Consecutive parts of ``texts`` of about ``size`` bytes, one text at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        yield texts.slice(at, stop - at)
        at = stop


def gather(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``chosen`` of ``values``, a sequence of runs of these
    ``lengths``, one after another, and where each begins."""
    starts, counts = np.cumsum(lengths) - lengths, lengths[chosen]
    before = np.concatenate([[0], np.cumsum(counts)])
    return values[np.repeat(starts[chosen] - before[:-1], counts) + np.arange(before[-1])], before


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for pieces that cannot hold a special name
        self.plain.encode_special_tokens = True
        self.words = Tokenizer.from_file(path)  # for words that are lower case and apart already
        self.words.encode_special_tokens = True
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.words.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.pieces: dict[str, np.ndarray] = {}  # those that are not Latin words

    def word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (lower case, apart) one after another, and how
        many each has."""
        starts = pa.array([*range(0, len(words), 200), len(words)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(starts, words), " ").to_pylist()
        own = [np.asarray(e.ids, "<u4") for e in self.words.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, "<u4"), *own])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("words and their ends do not match")
        return ids, np.diff(ends, prepend=0)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces of any kind; only those that may hold a
        special name go through the tokenizer that looks for them."""
        if len(self.pieces) > REMEMBER:
            self.pieces = {}
        new = [p for p in pieces if p not in self.pieces]
        for special in (True, False):
            some = [p for p in new if ("<|" in p) is special]
            model = self.whole if special else self.plain
            for piece, coded in zip(some, model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.pieces[piece] = np.asarray(coded.ids, "<u4")

    def ids_of(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and how many each has. Pieces
        of Latin letters and punctuation after them, nearly all, are taken
        apart, lower-cased and told apart in Arrow."""
        parts = pc.extract_regex(pieces, LATIN)
        latin = parts.is_valid()
        coded = pc.utf8_lower(pc.struct_field(parts, "word").filter(latin)).dictionary_encode()
        tails = pc.struct_field(parts, "tail").filter(latin).dictionary_encode()
        others = pieces.filter(pc.invert(latin)).to_pylist()
        self.learn(others)
        other_ids = [self.pieces[p] for p in others]
        word_ids, word_lengths = self.word_ids(coded.dictionary)
        # The dictionary of tails may hold the empty one, which is no word.
        some = pc.not_equal(tails.dictionary, "")
        tail_ids, some_lengths = self.word_ids(tails.dictionary.filter(some))
        tail_lengths = np.zeros(len(some), np.int64)
        tail_lengths[some.to_numpy(zero_copy_only=False)] = some_lengths
        lengths = np.concatenate([word_lengths, tail_lengths, np.fromiter(map(len, other_ids), np.int64, len(others))])
        # Two parts a piece: word and tail, or the whole piece and nothing (the part after the last).
        part = np.full((len(pieces), 2), len(lengths), np.int64)
        mask = latin.to_numpy(zero_copy_only=False)
        part[mask, 0] = coded.indices.to_numpy()
        part[mask, 1] = tails.indices.to_numpy() + len(word_lengths)
        part[~mask, 0] = np.arange(len(others)) + len(word_lengths) + len(tail_lengths)
        ids, _ = gather(np.concatenate([word_ids, tail_ids, *other_ids]), np.append(lengths, 0), part.ravel())
        return ids, np.append(lengths, 0)[part].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (little-endian unsigned 32-bit) and where each text's begin;
        null is empty."""
        spaced = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = spaced.flatten().dictionary_encode()
        ids, before = gather(*self.ids_of(coded.dictionary), coded.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(spaced).to_numpy())])
        return ids, before[bounds]

    def count(self, texts: pa.Array) -> np.ndarray:
        _, bounds = self.encode(texts)
        return np.diff(bounds)


class ByteBpe:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.fromiter((len(self.model.encode_ordinary(t or "")) for t in texts.to_pylist()), np.int64, len(texts))


TOKENIZERS = {"word_bpe_49k": ("word_bpe_49k.json", WordBpe), "byte_bpe_50k": ("byte_bpe_50k.tiktoken", ByteBpe)}


@functools.cache
def load(name: str, folder: str | None = None):
    """One model a worker process: it serves all of the process's tasks."""
    file, kind = TOKENIZERS[name]
    return kind(vocabulary(file, folder))
