"""Ranked search against scores of every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import sketch_search
from concordat.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def by_hand(docs: list[tuple], items: list[tuple], top: int = 10) -> Counter:
    terms = lambda t: Counter(TERM.findall((t or "").translate(LOWER)))
    held = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        ranked = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            score = 0
            for t, times in terms(text).items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += times * w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) if c[t] else 0
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(ranked, key=lambda r: r[:3])[:top]):
            out[item, rank + 1, i, -score] += 1
    return out


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op11_sketch_search"](spark, sf_dir)) == by_hand(docs, items)


def corpus(seed: int, n: int = 500) -> tuple[list, list]:
    """Few frequent and many rare words, lengths from 1 to 2,000, a third of the rows copies of one text."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    docs = [(i, " ".join(word() for _ in range(int(rng.paretovariate(0.7)) % 2000 + 1))) for i in range(n)]
    docs += [(n + i, "copy W1 w2 w3 w77 w78") for i in range(n // 2)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(100, "w1"), (101, "w77 w77 copy"), (102, "nowhere"), (103, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed, block, queries", [(1, 1 << 16, 99), (2, 150, 99), (3, 1, 3)])
def test_random_corpus(spark, seed, block, queries):
    docs, items = corpus(seed)
    items = items[-queries:]
    got = sketch_search.search(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, ITEMS), block_terms=block)
    assert found(got) == by_hand(docs, items)


def test_slabs_end_at_the_threshold(spark, monkeypatch):
    """Small slabs take several rounds, score a part of the documents and find the same."""
    docs, items = corpus(4, 800)
    scored = []
    plain = sketch_search._of_keys
    monkeypatch.setattr(sketch_search, "FIRST", 10)
    monkeypatch.setattr(sketch_search, "GROWTH", 2)
    monkeypatch.setattr(sketch_search, "_of_keys", lambda d, keys: scored.append(keys.count()) or plain(d, keys))
    long_items = [i for i in items if len(i[1].split()) > 10]
    got = found(sketch_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(long_items, ITEMS)))
    assert got == by_hand(docs, long_items)
    assert len(scored) > 1 and sum(scored) <= len(docs)


def test_bounds_are_never_below_scores(spark):
    docs, items = corpus(5, 200)
    frame = spark.createDataFrame(docs, DOCS).select("doc_id", "text", F.col("doc_id").alias("key"))
    block = next(sketch_search.blocks(spark.createDataFrame(items, ITEMS)))
    collection, df = sketch_search.collection_of(frame, np.unique(block.term))
    weighed = block.weighed(collection, df)
    none = np.zeros(len(block.items), np.int64)
    bounds = {(r["query"], r["key"]): r["bound"] for r in sketch_search.above(sketch_search.sketches(frame, collection), weighed, none).collect()}
    scores = sketch_search.scored(frame, weighed, collection, none + 1, 10**6).collect()
    assert len(scores) > 1000
    assert all(r["score"] <= bounds[r["query"], r["doc_id"]] for r in scores)
    # And they tell most other documents from those.
    assert sum(b > 0 for b in bounds.values()) < len(bounds)


ODD = [
    (1, None), (2, ""), (3, " -_.~\t"), (4, "Wörter ÜBEN ß a1b2"), (5, "wörter üben"), (5, "wörter üben"), (None, "wörter ÜBEN ß"), (None, "wörter üben"),
    (6, "x" * 200_000 + " ß"), (7, "many " * 50_000), (8, " ".join(f"t{i}" for i in range(30_000)) + " ß"), (9, "a b\u0085c a b c"),
]
ODD_ITEMS = [(1, None), (2, "..."), (None, "ß wörter ß"), (3, "WÖRTER wÖrter"), (4, "a b\u0085c"), (4, "a b c many t5"), (4, "a b c many t5"), (5, "zzz")]


def test_odd_texts(spark):
    docs, items = spark.createDataFrame(ODD, DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)
    want = by_hand(ODD, ODD_ITEMS)
    assert found(sketch_search.search(docs, items)) == want
    names = ("key", "sketch", "query", "bound", "least", "rank", "score", "terms", "Place")
    assert found(sketch_search.search(*(d.select("*", *[F.lit("x").alias(n) for n in names]) for d in (docs, items)))) == want
    assert found(sketch_search.search(docs, items, top=2)) == by_hand(ODD, ODD_ITEMS, 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD, DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)
    assert sketch_search.search(docs.limit(0), items).collect() == []
    assert sketch_search.search(docs, items.limit(0)).collect() == []
    assert sketch_search.search(docs.where("doc_id < 4"), items).collect() == []
