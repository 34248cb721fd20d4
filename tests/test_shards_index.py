"""Shard merges, a kept index, clinical neighbours, against plain Python."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import decontaminate, merging, retrieval


def test_kept_index_scores_like_a_new_one(spark):
    rows = [(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 12 + k % 5))) for k in range(60)] + [(70, ""), (71, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "w1 w3 w3"), (2, "w16 nothing"), (3, "")], "q long, text string")
    spark.sql("DROP TABLE IF EXISTS kept_postings"), spark.sql("DROP TABLE IF EXISTS kept_segments")
    body = F.coalesce("text", F.lit(""))
    scores = lambda df: {(r.q, r.id): round(r.score, 9) for r in df.collect()}
    retrieval.write_index(docs.where("id < 20"), "id", body, "kept", "a", buckets=4)
    first = scores(retrieval.indexed_scores(queries, "kept", "q", "id", "text"))
    assert first == scores(retrieval.bm25_scores(queries, docs.where("id < 20"), "q", "id", "text", body))
    retrieval.write_index(docs.where("id >= 20"), "id", body, "kept", "b", buckets=4)
    retrieval.write_index(docs.where("id >= 20"), "id", body, "kept", "b", buckets=4)  # written again, as by a repeated job
    # Postings whose segment was never told of are not read.
    left = retrieval.postings(docs.limit(5), "id", body).withColumn("segment", F.lit("lost"))
    left.write.bucketBy(4, "term").sortBy("term").format("parquet").mode("append").saveAsTable("kept_postings")
    found = retrieval.indexed_scores(queries, "kept", "q", "id", "text")
    assert scores(found) == scores(retrieval.bm25_scores(queries, docs, "q", "id", "text", body)) != first
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.table("kept_postings").join(spark.range(9).select(F.concat(F.lit("w"), "id").alias("term")), "term")
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # of the terms, not of the postings
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kept_postings"), spark.sql("DROP TABLE kept_segments")


def test_bm25_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "a bb cc")], "id long, text string")
    queries = spark.createDataFrame([(1, "bb")], "q long, text string")
    plan = retrieval.bm25_scores(queries, docs, "q", "id", "text", F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert not any("text#" in line and "Exchange" in line for line in plan.splitlines())


ROWS = [(0, "a", "v7"), (0, "b", "v7"), (1, "c", "v7"), (2, "d", "v7")]
SPECS = [(0, "a", "v7"), (1, "b", None), (1, "c", ""), (1, "d", "v7")]


def test_sound_shards_merge(spark):
    rows, specs = (spark.createDataFrame(x, "shard int, case_id string, version string") for x in (ROWS, SPECS))
    a, b = merging.merge_shards(rows, specs, "v7")
    assert sorted(r.case_id for r in a.collect()) == sorted(r.case_id for r in b.collect()) == list("abcd")
    manifests = spark.createDataFrame([(0, 7), (9, 2)], "shard int, attempts int")
    assert sorted(map(tuple, merging.shard_statistics(rows, specs, manifests).collect())) == [(0, 2, 1, 7), (1, 1, 3, 0), (2, 1, 0, 0), (9, 0, 0, 2)]


def test_unsound_shards_are_an_error(spark):
    rows = spark.createDataFrame([*ROWS, (3, "a", "v7"), (3, "e", "v6"), (3, None, "v7"), (3, "", None)], "shard int, case_id string, version string")
    specs = spark.createDataFrame([*SPECS, (3, "f", "v6")], "shard int, case_id string, version string")
    found = sorted((r.side, r.key or "", r.issue) for r in merging.shard_issues(rows, specs, "v7").collect())
    assert found == [
        ("row", "", "missing_id"), ("row", "", "missing_id"), ("row", "", "version_mismatch"), ("row", "a", "duplicate_id"), ("row", "e", "missing_spec"), ("row", "e", "version_mismatch"),
        ("spec", "f", "orphan_spec"), ("spec", "f", "version_mismatch"),
    ]
    with pytest.raises(ValueError, match="row a: duplicate_id"):
        merging.merge_shards(rows, specs, "v7")


def test_clinical_neighbours(spark):
    intakes = [{"symptoms": "Chest pain", "vitals": {"pulse": 90, "a": [True, None]}, "responder_note": "x", "target_protocol_card_hint": "y"}, {"vitals": {"a": [True, None], "pulse": 90}, "symptoms": "Chest pain"}, {}]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(intakes)] + [(9, "[1]"), (10, None)], "k int, j string")
    found = {r.k: (r.h, r.t) for r in df.select("k", decontaminate.clinical_hash(F.col("j")).alias("h"), decontaminate.clinical_tokens(F.col("j")).alias("t")).collect()}
    for k, x in enumerate(intakes):
        kept = json.dumps({a: b for a, b in x.items() if a not in decontaminate.NOT_CLINICAL}, sort_keys=True, separators=(",", ":"))
        assert found[k] == ("sha256:" + hashlib.sha256(kept.encode()).hexdigest(), sorted(set(re.findall("[a-z0-9]+", kept.lower()))))
    assert found[0] == found[1] and found[9] == (None, []) == found[10]


def test_near_only_with_the_same_target_or_workflow(spark):
    tokens = [f"t{k}" for k in range(20)]
    docs = [(1, tokens, "x1", "T", "W"), (2, tokens, "x2", "U", "W"), (3, tokens, "x3", "U", ""), (4, tokens, "same", "U", "V"), (5, tokens[:10], "x5", "T", "W"), (6, tokens, "x6", None, None)]
    items = spark.createDataFrame([(100, tokens, "same", "T", "W"), (101, tokens, "other", "Z", "")], "item long, tokens array<string>, content string, target string, workflow string")
    df = spark.createDataFrame(docs, "doc long, tokens array<string>, content string, target string, workflow string")
    found = {tuple(r) for r in decontaminate.exclusion_matches(df, items, "doc", "item", 0.92, "target", "workflow").collect()}
    assert found == {(1, 100, "near"), (2, 100, "near"), (4, 100, "exact")}
    assert len(decontaminate.exclusion_matches(df, items, "doc", "item", 0.92).collect()) == 10
