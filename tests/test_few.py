import re

import __spark_entry__
import numpy as np
from pyspark.sql import functions as F
from test_small_tables import documents, held

from sievework.operators import decontaminate, few, retrieval
from sievework.plans import dims
from sievework.sources.tables import fixed, is_small

ITEMS = "item_id long, text string"
COPIES = ["the same words"] * 14
TEXTS = documents("Alpha beta beta", "-", "", "gamma alphabet é alpha", "a b c", "beta, gamma; BETA\nalpha", *COPIES)
ASKED = ITEMS, [(3, "alpha beta beta"), (7, "words the zz"), (8, None), (9, ""), (10, "bet"), (11, "qqq")]


def moved(df):
    """Exchanges in the plan, but for broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bm25_of_copies_and_blanks(spark, tmp_path):
    found = held(spark, tmp_path, "q11_bm25_topk", documents=TEXTS, benchmark=ASKED)
    assert [r[1] for r in sorted(found, key=lambda r: r[3]) if r[0] == 7] == list(range(6, 16))


def test_forced_then_ranked(spark, tmp_path):
    held(spark, tmp_path, "q13_forced_then_ranked", documents=TEXTS, benchmark=ASKED)


def test_forced_then_ranked_shuffles_no_words_of_documents(spark, tmp_path):
    """Only each task's best of each item moves, so a task's memory does not grow with the documents."""
    held(spark, tmp_path, "q13_forced_then_ranked", documents=TEXTS, benchmark=ASKED)
    plan = __spark_entry__.queries()["q13_forced_then_ranked"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [d for d in dealt if "term" in d or not d.startswith("item_id")]


def test_terms_inside_words_and_titles(spark, tmp_path):
    held(spark, tmp_path, "q10_term_score_topk", documents=TEXTS, benchmark=(ITEMS, [*ASKED[1], (12, "we eb"), (13, "web")]))


def test_fallback_for_queries_without_results(spark, tmp_path):
    found = held(spark, tmp_path, "q12_retrieval_fallback", documents=TEXTS, benchmark=ASKED)
    assert (10, 3, "substring") in found


def test_engine_mix(spark, tmp_path):
    held(spark, tmp_path, "q73_engine_mix", documents=documents("nation", "ntio ntiontio", "none"))


def test_documents_stay_where_they_are_read(spark):
    docs = spark.createDataFrame(TEXTS[1], TEXTS[0])
    queries = fixed(spark, ((1, "alpha beta"),), "q", "t")
    assert is_small(queries) and is_small(fixed(spark, dims.EXTRA_QUERIES, "item_id", "text"))
    # One exchange: of each task's best.
    assert moved(retrieval.best_by_bm25(queries, docs, "q", "doc_id", "t", F.col("text"), 3)) == 1
    assert moved(retrieval.best_by_terms(queries, docs, "q", "doc_id", "t", F.col("text"), 3)) <= 2


def test_many_queries_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS[1], TEXTS[0])
    queries = fixed(spark, tuple((k, t or "") for k, t in ASKED[1]), "q", "t")
    made = lambda f, *more: sorted(map(tuple, f(queries, docs, "q", "doc_id", "t", F.col("text"), 4, *more).collect()))
    first = made(retrieval.best_by_bm25), made(retrieval.best_by_terms), made(retrieval.best_by_terms, F.col("source"))
    monkeypatch.setattr(retrieval, "is_small", lambda df: False)
    assert first == (made(retrieval.best_by_bm25), made(retrieval.best_by_terms), made(retrieval.best_by_terms, F.col("source")))


def test_best_keeps_all_that_can_count(monkeypatch):
    monkeypatch.setattr(few, "ENTRIES", 40)
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 4, (500, 3)) * 0.5
    kept = few.Best(3, 5)
    for at in range(0, 500, 23):
        kept.add(scores[at : at + 23], np.arange(at, min(at + 23, 500))[::-1])
    query, score, key = kept.prune()
    flipped = np.concatenate([np.arange(at, min(at + 23, 500))[::-1] for at in range(0, 500, 23)])
    for q in range(3):
        rows = sorted((-scores[k, q], flipped[k]) for k in range(500) if scores[k, q] > 0)[:5]
        assert sorted(zip(-score[query == q], key[query == q]))[:5] == rows
    assert len(query) < 60


def test_overlaps_with_copies_and_blanks(spark, tmp_path):
    docs = documents("the same words", "the same", "", "beta", "other words here", "alpha beta beta", *COPIES)
    items = ITEMS, [(0, "the same words"), (1, "alpha beta beta"), (2, ""), (3, "here are other words"), (4, "zz")]
    for name in ("q19_cue_coverage", "q20_missing_cue_counts", "q37_first_exclusion_match", "q38_contamination_containment"):
        assert held(spark, tmp_path / name, name, documents=docs, benchmark=items)


def test_overlaps_shuffle_no_document(spark, monkeypatch):
    sets = lambda rows: decontaminate.token_sets(spark.createDataFrame(rows, "d long, t string"), "d", F.col("t"))
    docs, own = sets([(k, t) for k, t in enumerate(["a b c", "b c", "", "x"])]), fixed(spark, ((7, "a b"), (8, "c x y")), "i", "t")
    items = decontaminate.token_sets(own, "i", F.col("t"))
    found = decontaminate.overlaps(docs, items, "d", "i", 0.3, lacking=True)
    assert moved(found) == 0
    monkeypatch.setattr(decontaminate, "is_small", lambda df: False)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, decontaminate.overlaps(docs, items, "d", "i", 0.3, lacking=True).collect()))
