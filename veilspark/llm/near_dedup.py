"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles,
banded, verified by weighted Jaccard similarity.

1. Exact copies collapse to one text (by MD5), so a text that a third of all
   rows repeat is one item from here on.
2. A shingle is five consecutive words, lower-cased; its weight in a text is its
   count times its inverse document frequency. Frequencies of all documents are
   kept in a count-min sketch of ``BUCKETS`` counters, summed over partitions, so
   what is broadcast has a fixed size. The frequency is smoothed by a tenth of
   the corpus: passages shared by large parts of it weigh little, while a
   group of copies does not lose the weight that makes it one.
3. Improved consistent weighted sampling draws ``ROWS * BANDS`` samples a text;
   two texts agree in one with probability equal to their weighted Jaccard
   similarity. Texts that agree in a whole band share a bucket.
4. In each bucket every text is compared with one of them (its least id) and
   linked to it if their samples agree in enough places. Where one fails, the
   least id may be a third text that shares only a passage: then all the texts
   of the bucket, but those almost equal to the least id, are compared with
   each other by their samples, in square blocks. Connected components of these
   links are families: sets within which near-duplicates can lie.
5. Inside a family all pairs are verified exactly, in square blocks of at most
   about ``2 * BLOCK`` texts, by the weights their shingles share. A block gives
   back a spanning forest of its similar pairs, never the pairs. Components of
   these links are the classes.

Families are cut into blocks, so no task holds more than two blocks however
large a group of near copies is. Texts travel once, to be verified, and only
one row for each distinct text that is in a family.

Defined cases: null and empty texts, or texts of white space only, have no
shingles: equal ones are copies, otherwise they resemble nothing; a text of
fewer than five words is one shingle; rows are classed by their text, so
repeated rows, null ids and one id with several texts are all classed; a class
is named by its least ``doc_id`` (null if it has none); empty tables give empty
results; extra columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, whole_text

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 3, 8
SAMPLES = ROWS * BANDS
#: Samples that a link needs to agree in; at similarity 0.8 fewer are met once in 10^5 pairs.
AGREE = 11
#: Samples in which a text stands for another: whoever agrees with one agrees with both (two may differ).
SAME = 22
POOL = 512
PARTS = 1024
BUCKETS = 1 << 16
SMOOTHING = 0.1
BLOCK = 256
SEED = 7
CHUNK = 1 << 14
COLUMNS = 2048
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.trim(F.lower(text)), r"\s+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of up to 65,536 texts: text number, shingle (48 bits) and its count in
    the text, sorted by text and shingle."""
    lengths = np.nan_to_num(np.asarray(words.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = words.flatten().to_numpy().view(np.uint64)
    padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
    texts = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(flat))  # words from here to the text's end
    first = left == np.repeat(lengths, lengths)
    hashed, factor = np.zeros(len(flat), np.uint64), int(ODD)
    for j in range(SHINGLE):
        hashed += np.where(left > j, padded[j:j + len(flat)], np.uint64(0)) * np.uint64(factor)
        factor = factor * int(ODD) % (1 << 64)
    kept = (left >= SHINGLE) | first
    keys = (texts[kept].astype(np.uint64) << np.uint64(48)) | (mix(hashed[kept]) >> np.uint64(16))
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    keys = keys[starts]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts


def bucket_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of the sketch and the number of documents, over all of ``docs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            documents += len(batch)
            for at in range(0, len(batch), 1 << 16):
                counters += np.bincount(bucket_of(shingles(batch.column(0).slice(at, 1 << 16))[1]), minlength=BUCKETS)
        used = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counters[used], documents))], ["bucket", "n"])

    found = docs.select(word_hashes(whole_text()).alias("words")).mapInArrow(count, "bucket long, n long")
    counters, documents = np.zeros(BUCKETS, np.int64), 0
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row["bucket"] < 0:
            documents = row["n"]
        else:
            counters[row["bucket"]] = row["n"]
    return counters, documents


def inverse_frequencies(counters: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p(documents / (counters + SMOOTHING * documents + 1e-9))


def sample(texts: np.ndarray, shingle: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``SAMPLES`` fingerprints for each of ``n`` texts (rows without shingles 0).

    For each sample, shingle and weight w with r, c ~ Gamma(2, 1), b ~ U(0, 1) from
    the shingle: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The sample
    is the (shingle, t) of least a."""
    seeds = np.random.default_rng(SEED).integers(1, 1 << 63, size=(SAMPLES, 2), dtype=np.uint64)
    out = np.zeros((n, SAMPLES), np.uint32)
    has = np.unique(texts)
    starts = np.searchsorted(texts, has)
    least = np.empty((SAMPLES, len(shingle)), np.uint64) if len(shingle) <= 4 * CHUNK else None
    logs = np.log(weights).astype(np.float32)
    for k in range(SAMPLES):
        keys = least[k] if least is not None else np.empty(len(shingle), np.uint64)
        for at in range(0, len(shingle), CHUNK):
            part, log = shingle[at:at + CHUNK], logs[at:at + CHUNK]
            u, v = mix(part ^ seeds[k, 0]), mix(part * ODD ^ seeds[k, 1])
            low, step = np.uint64(0xFFFFFF), np.float32(2.0 ** -24)
            uniform = lambda bits: ((bits & low).astype(np.float32) + np.float32(0.5)) * step
            r = -np.log(uniform(u) * uniform(u >> np.uint64(24)))
            c = -np.log(uniform(v) * uniform(v >> np.uint64(24)))
            b = uniform((u >> np.uint64(48)) | ((v >> np.uint64(48)) << np.uint64(16)))
            t = np.floor(log / r + b)
            order = (np.log(c) - r * (t - b + np.float32(1))).view(np.int32)
            order ^= (order >> 31) & np.int32(0x7FFFFFFF)  # bits in the order of the values
            name = (u ^ (t.astype(np.int64).view(np.uint64) * ODD)) & np.uint64(0xFFFFFFFF)
            keys[at:at + CHUNK] = ((order.astype(np.int64) + (1 << 31)).astype(np.uint64) << np.uint64(32)) | name
        if len(has):
            out[has, k] = (np.minimum.reduceat(keys, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``id`` (MD5 of the text), ``doc_id`` and ``samples`` (null without shingles) of each row."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                piece = batch.slice(at, 2000)
                texts, shingle, counts = shingles(piece.column("words"))
                drawn = sample(texts, shingle, counts * idf[bucket_of(shingle)], len(piece)).view(np.int32)
                none = np.bincount(texts, minlength=len(piece)) == 0
                lists = pa.FixedSizeListArray.from_arrays(pa.array(drawn.ravel()), SAMPLES).cast(pa.list_(pa.int32()))
                lists = pa.array([None if x else y for x, y in zip(none, lists.to_pylist(), strict=True)], pa.list_(pa.int32())) if none.any() else lists
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("doc_id"), lists], ["id", "doc_id", "samples"])

    rows = docs.select(F.md5(whole_text()).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), word_hashes(whole_text()).alias("words"))
    return rows.mapInArrow(draw, "id string, doc_id long, samples array<int>")


def spanning(alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation."""
    left, links = np.ones(len(alike), bool), []
    for start in range(len(alike)):
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            i = stack.pop()
            new = np.flatnonzero(alike[i] & left)
            left[new] = False
            links.extend((i, j) for j in new.tolist())
            stack.extend(new.tolist())
    return links


def pooled_links(pools: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest, per pool and pair of blocks, of the pairs whose
    samples agree. ``pools(pool, blocks, id, samples)``. Pools of one block share
    ``PARTS`` groups."""
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pool")
        ids, pool, block = table.column("id"), table.column("pool").to_numpy(), table.column("block").to_numpy()
        samples = table.column("samples").combine_chunks().flatten().to_numpy().reshape(len(ids), SAMPLES)
        ends, a, b = np.append(np.flatnonzero(pool[1:] != pool[:-1]) + 1, len(pool)), [], []
        for start, stop in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own, own_block = samples[start:stop], block[start:stop]
            same = np.zeros((len(own), len(own)), np.uint8)
            for k in range(SAMPLES):
                same += own[:, k, None] == own[None, :, k]
            alike = same >= AGREE
            if key[1].as_py() != key[2].as_py():
                alike &= own_block[:, None] != own_block[None, :]
            links = spanning(alike & ~np.eye(len(own), dtype=bool))
            a.extend(start + i for i, _ in links)
            b.extend(start + j for _, j in links)
        at = lambda places: ids.take(pa.array(places, pa.int64()))
        return pa.table({"a": at(a), "b": at(b)})

    blocks = F.col("blocks")
    cut = pools.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    cut = cut.withColumn("part", F.when(blocks > 1, F.col("pool")).otherwise(F.pmod("pool", F.lit(PARTS))))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    paired = paired.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "pool", "block", "id", "samples")
    return paired.groupBy("part", "low", "high").applyInArrow(compare, "a string, b string")


def candidate_links(texts: DataFrame) -> DataFrame:
    """``a, b``: each text of a bucket with the bucket's least id, if their
    samples agree often enough, at most ``BANDS`` links a text. In buckets where
    one does not, a forest of the pairs that agree among the others (see 4)."""
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.xxhash64(*[F.col("samples")[n * ROWS + i] for i in range(ROWS)]).alias("key"))
                      for n in range(BANDS)])
    banded = texts.where("samples is not null").select("id", F.inline(bands))
    least = banded.groupBy("band", "key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starred = land(banded.join(least, ["band", "key"]).where("id <> b").select(F.xxhash64("band", "key").alias("pool"), F.col("id").alias("a"), "b"), "starred")
    of = lambda name: texts.select(F.col("id").alias(name), F.col("samples").alias(f"samples_{name}"))
    same = F.size(F.filter(F.zip_with("samples_a", "samples_b", lambda x, y: x == y), lambda e: e))
    compared = starred.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    compared = land(compared.select("a", "b", same.alias("same")), "compared")
    apart = starred.join(compared.where(F.col("same") < SAME), ["a", "b"])
    sizes = apart.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("worst")).where((F.col("n") > 1) & (F.col("worst") < AGREE))
    pools = apart.join(sizes.select("pool", F.ceil(F.col("n") / POOL).cast("int").alias("blocks")), "pool")
    pools = pools.select("pool", "blocks", F.col("a").alias("id")).join(texts.select("id", "samples"), "id")
    return compared.where(F.col("same") >= AGREE).select("a", "b").union(pooled_links(pools)).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every end of ``links(a, b)``: the least id of its
    component. Each round maps every end to its least neighbour's least
    neighbour and contracts the links by that map, so links shrink from round to
    round and rounds grow with the logarithm of a component's diameter. Each
    round is written to the shared folder."""
    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links = land(ordered(links), "links")
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("label", F.col("id"))
    while links.limit(1).count():
        least = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))  # the lesser end of a link maps to itself, unless it has a lesser one
        ahead = least.select(F.col("v").alias("m"), F.col("m").alias("n"))
        to = land(least.join(ahead, "m", "left").select("v", F.coalesce("n", "m").alias("m")), "heads")
        on = lambda name: to.select(F.col("v").alias(name), F.col("m").alias(f"m_{name}"))
        labels = land(labels.join(on("label"), "label", "left").select("id", F.coalesce("m_label", "label").alias("label")), "labels")
        links = land(ordered(links.join(on("a"), "a", "left").join(on("b"), "b")
                             .select(F.coalesce("m_a", "a").alias("a"), F.col("m_b").alias("b"))), "links")
    return labels


class Forest:
    """Union-find that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[a] = b
            self.links.append((i, j))


def shared_weight(texts: np.ndarray, shingle: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the lesser weights for each pair of texts, and the sum of weights
    of each. The jth occurrence of a shingle is an element of its own, so
    lesser weights are those of common elements."""
    places = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
    element = mix(shingle[places] + number.astype(np.uint64) * ODD)
    owner, weight = texts[places], idf[bucket_of(shingle)][places]
    total = np.bincount(owner, weight, n)
    _, column, held = np.unique(element, return_inverse=True, return_counts=True)
    common = held[column] > 1
    owner, weight = owner[common], np.sqrt(weight[common])
    _, column = np.unique(column[common], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    both = np.zeros((n, n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        start, stop = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((n, COLUMNS))
        dense[owner[start:stop], column[start:stop] - at] = weight[start:stop]
        both += dense @ dense.T
    return both, total


def verified_links(members: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """``a, b``: a spanning forest, per pair of blocks, of the pairs of one
    family that are similar. ``members(family, blocks, block, id, words)``."""
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids, block = table.column("id").to_pylist(), table.column("block").to_numpy()
        texts, shingle, counts = shingles(table.column("words").combine_chunks())
        both, total = shared_weight(texts, shingle, counts, idf, len(ids))
        alike = both >= (similar - 1e-9) * (total[:, None] + total[None, :] - both)
        if key[1].as_py() != key[2].as_py():
            alike &= block[:, None] != block[None, :]
        forest = Forest(len(ids))
        for i, j in np.argwhere(np.triu(alike, 1)).tolist():
            forest.join(i, j)
        return pa.table({"a": pa.array([ids[i] for i, _ in forest.links], pa.string()), "b": pa.array([ids[j] for _, j in forest.links], pa.string())})

    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.select("family", "block", "id", "words", others.alias("other"))
    paired = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    return paired.groupBy("family", "low", "high").applyInArrow(verify, "a string, b string")


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(whole_text())))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, id, class_id, kept`` for each row of ``docs(doc_id, text)``:
    ``id`` is the text's MD5 and ``kept`` marks the rows of one id and text
    that stand for their class."""
    counters, documents = document_frequencies(docs)
    idf = inverse_frequencies(counters, documents)
    drawn = land(signatures(docs, idf), "signatures")
    texts = land(drawn.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("samples").alias("samples")), "texts")
    family = components(candidate_links(texts)).select("id", F.col("label").alias("family"))
    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = family.join(sizes, "family").join(texts.select("id", "doc_id"), "id")
    members = members.select("family", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id",
                             F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "id")).alias("_row"))
    found = docs.select(row_key().alias("_row"), whole_text().alias("_text")).join(members, "_row").dropDuplicates(["_row"])
    links = verified_links(found.select("family", "blocks", "block", "id", word_hashes(F.col("_text")).alias("words")), idf, similar)
    grouped = components(links)
    labelled = texts.select("id", "doc_id").join(grouped, "id", "left").select("id", "doc_id", F.coalesce("label", "id").alias("label"))
    named = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).getField("id").alias("_first"))
    named = land(labelled.select("id", "doc_id", "label").join(named, "label")
                 .select("id", "class_id", ((F.col("id") == F.col("_first"))).alias("_stands"), F.col("doc_id").alias("_by")), "classes")
    out = drawn.select("doc_id", "id").join(named, "id")
    return out.select("doc_id", "id", "class_id", (F.col("_stands") & F.col("doc_id").eqNullSafe(F.col("_by"))).alias("kept"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class, the one with the least ``doc_id``; all columns kept."""
    stays = classes(docs, similar).where("kept").select(
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "id")).alias("_row")).distinct()
    return docs.withColumn("_row", row_key()).join(stays, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
