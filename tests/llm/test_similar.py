"""The pipeline's near-dedup stage against brute force, on planted near copies."""

import random

import pytest

pytest.importorskip("sievework.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 20000)}"
    texts, at = [], 0
    for k in range(60):
        base = [word() for _ in range(rng.choice((100, 300, 1000)))]
        copy = list(base)
        goal = 0.78 + 0.17 * k / 60
        order = rng.sample(range(len(base)), len(base))
        while True:
            nearer = list(copy)
            nearer[order.pop()] = word()
            if similarity(sets_of(" ".join(base)), sets_of(" ".join(nearer))) < goal:
                break
            copy = nearer
        texts += [" ".join(base), " ".join(copy)]
    chain = [word() for _ in range(200)]
    for _ in range(30):
        texts.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    texts += ["", None, " \n", "one two", "ONE  two", "one two three", texts[0], texts[0].upper()]
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]


def test_near_dedup_finds_copies_from_similarity_0_8(spark, tmp_path):
    rows = planted()
    sets = [sets_of(r[1]) for r in rows]
    group, linked = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                linked += similarity(sets[a], sets[b]) < 0.95
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    assert linked > 60
    least = {}
    for g, row in zip(group, rows):
        least[g] = min(least.get(g, row[0]), row[0])
    kept = dict(corpus_pipeline.STAGES)["near-dedup"](spark, spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_parities_never_exclude_a_similar_pair(spark):
    np = pytest.importorskip("numpy")
    from pyspark.sql import functions as F

    from sievework.llm import similar

    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep, new = a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 3)))).astype(np.uint64)
        b = np.unique(np.concatenate([keep, new]))
        rows.append((k, len(set(a.tolist()) ^ set(b.tolist())), similar.parities(a).tolist(), similar.parities(b).tolist()))
    df = spark.createDataFrame(rows, "k int, apart int, a array<long>, b array<long>")
    for r in df.where("size(a) <= 2 * size(b) and size(b) <= 2 * size(a)").withColumn("d", similar.least_difference("a", "b")).collect():
        assert r.d <= r.apart
        assert r.apart > 20 or r.d >= r.apart - 12
    assert df.where("size(a) <> size(b)").count() > 20
