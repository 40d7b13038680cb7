import itertools
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from veilspark.llm import filter_audit
from veilspark.sources.tables import table

from ..conftest import SF

DOCS = "doc_id long, text string, source string, fails int, n string"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Filters applied document by document, order by order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                own = out.setdefault((source or "", "".join(order), step), Counter())
                if fails[f]:
                    own["redundant" if gone else "removed"] += 1
                    own["unique_fails"] += sum(fails.values()) == 1
                    if not gone:
                        own["good_lost"] += i in good
                        own["toxic_lost"] += i in toxic
                        shapley[source or "", f] += 1
                    gone = True
                own["kept"] += not gone
    return {k: tuple(v[n] if n != "shapley" else shapley[k[0], k[1][k[2] - 1]] for n in NAMES) for k, v in out.items()}


def result(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in filter_audit.audit(docs, labels).collect()}


def test_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = result(docs, labels)
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert len(got) == 600 * docs.select("source").distinct().count()


def test_nulls_ties_repeats_long(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [(1, many, "a"), (2, many, "a"), (2, many, "b"), (1, many, "b"), (None, many, None), (None, None, None), (None, None, "a"), (3, "", ""),
            (4, "A B\x0bC\xa0D", "a"), (5, "x " * 60000, "a"), (6, "#", None), (9, many + " ", "a")] + [(7, "HOT text | here", "hot")] * 200 + [(8, "HOT text | here", "hot")] * 100
    labels = [(1, 1, None), (1, 0, 1), (8, 0, 1), (None, 1, 1), (2, 1, 0), (2, 1, 0), (77, 1, 1)]
    rows = spark.createDataFrame([(*d, 3, "clash") for d in docs], DOCS).repartition(6)
    assert result(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == brute(docs, labels)
    assert result(rows.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")) == {}


def test_sketch_never_clears_a_repeat(spark):
    rows = spark.range(30000).select("id", F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id") + 10**6)).alias("_h"))
    for blocks in (1, filter_audit.blocks_for(30000)):
        merged = filter_audit.sketch(rows.repartition(7).select("_h"), blocks)
        told = filter_audit.maybe_repeated(rows, merged, blocks)
        assert told.count() == 30000 and told.where("id % 10 = 0 AND NOT _maybe").count() == 0
        unique = told.where("id % 10 <> 0").agg(F.avg(F.col("_maybe").cast("double"))).first()[0]
    assert unique < 0.02


def test_counts_stop_at_two():
    assert filter_audit.twice(np.array([3, 1, 3, 3, 2, 3, 1])).tolist() == [1, 1, 2, 3, 3]
    assert filter_audit.blocks_for(0) == 1 and filter_audit.blocks_for(10**12) << filter_audit.BLOCK_BITS == filter_audit.MOST_CELLS


def test_unique_texts_are_not_shuffled(spark):
    docs = table(spark, SF, "documents")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    blocks = filter_audit.blocks_for(docs.count())
    some = filter_audit.maybe_repeated(texts, filter_audit.sketch(texts.select("_h"), blocks), blocks).where("_maybe").count()
    again = docs.groupBy("text").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert again <= some <= again + 0.05 * docs.count()
