"""op13 against brute force: ties, copies, repeats, nulls, clusters of few documents, blocks of few items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sievework.llm")

from pyspark.sql import functions as F  # noqa: E402

from sievework.llm import search  # noqa: E402

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 25 + 75 * bag.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    topics = [[f"{c}{k}" for k in range(40)] for c in ("a", "b", "É", "日")]
    text = lambda: " ".join(rng.choice(("the", "OF", *rng.choice(topics[:1] + [t] * 3))) for t in [rng.choice(topics)] for _ in range(rng.randint(1, 60)))
    docs = [(k, text()) for k in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(120)] + [(None, docs[7][1]), (None, None), (600, ""), (601, " ,.\n"), (602, "the " * 9000), (603, "x" * 4000), (5, docs[9][1]), (5, docs[9][1])]
    items = [(k, docs[k * 7][1] + "-the_a1") for k in range(20)] + [(3, "the the of"), (3, "the the of"), (None, "a1 b1"), (50, None), (51, ""), (52, "nothing-known"), (53, docs[7][1])]
    return docs, items


@pytest.fixture(scope="module")
def data():
    return corpus()


def got(spark, docs, items, **settings):
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    return sorted((tuple(r) for r in search.rank(d, i, **settings).collect()), key=repr)


@pytest.mark.parametrize("levels,block", [(0, 1 << 18), (3, 1 << 18), (3, 1500)])
def test_like_brute_force(spark, data, monkeypatch, levels, block):
    monkeypatch.setattr(search, "LEAST_DOCUMENTS", 16)
    assert got(spark, *data, levels=levels, block=block) == brute(*data)


def test_small_score_tables(spark, data, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 40)
    assert got(spark, *data, levels=2, top=3) == brute(*data, top=3)


def test_clusters_are_skipped(spark, data, monkeypatch):
    """Topics fall apart in the bisection, so an item of one topic leaves clusters of the others unvisited."""
    monkeypatch.setattr(search, "LEAST_DOCUMENTS", 8)
    rng = random.Random(1)
    docs = [(k, " ".join(f"t{k % 4}w{rng.randint(0, 30)}" for _ in range(30))) for k in range(400)]
    items = [(k, docs[k][1]) for k in range(12)]
    told = []
    assert got(spark, docs, items, levels=3, rounds=6, seen=told.append) == brute(docs, items)
    assert told[0]["clusters"] == 8
    assert told[0]["visits"] <= 0.5 * told[0]["clusters"] * told[0]["items"]


def test_bisection_brings_alike_documents_together(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(f"t{k % 4}w{rng.randint(0, 20)}" for _ in range(25))) for k in range(600)]
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for _, x in docs for t in terms(x)}))}
    state = search.cut(search.forward_rows(spark.createDataFrame(docs, DOCS), vocabulary, "text", "doc_id"), "test")
    df = np.array([sum(t.decode() in x.split() for _, x in docs) for t in sorted(vocabulary)])
    rows = search.bisect(state, df, len(docs), 2, 8).select("doc_id", "cluster").collect()
    assert len(rows) == 600
    largest = sum(max(Counter(r["doc_id"] % 4 for r in rows if r["cluster"] == c).values()) for c in range(4))
    assert largest > 0.8 * 600


def test_swaps_give_equally_many():
    rng = np.random.default_rng(0)
    histogram = rng.integers(0, 9, (4, 2 * search.BINS)).astype(float)
    moved = search.swap_shares(histogram) * histogram
    assert np.allclose(moved[0].sum(), moved[1].sum()) and np.allclose(moved[2].sum(), moved[3].sum())
    assert (moved <= histogram + 1e-9).all()
    assert moved.sum() > 0


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(search, "SLICE", 7)
    text = "Abc dEf ééé, 12x-yz_abc 日本 " * 50
    assert {t.decode(): n for t, n in search.count_terms(text.encode()).items()} == Counter(terms(text))


def test_empty_tables_and_more_columns(spark, data):
    docs, items = data
    assert got(spark, [], items) == [] == got(spark, docs, []) == got(spark, [(1, None)], items)
    d = spark.createDataFrame(docs[:60], DOCS).withColumns({c: F.lit("mine") for c in ("n", "terms", "tfs", "salt", "cluster", "score", "rank", "query")})
    found = search.rank(d, spark.createDataFrame(items, ITEMS).withColumn("query", F.lit(1)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs[:60], items)
