"""Whole runs over tables of cases: screen, retrieve, produce, validate, fall back, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.hashing import stable_hash
from sievework.operators import intake, navigation, retrieval, validation
from sievework.sources.jsonl import known_keys


def run_cases(cases: DataFrame, cards: DataFrame, key: str = "case_id", model_output: str | None = None, limit: int = navigation.MOST_CARDS) -> DataFrame:
    """One row a case: fired rules, floor, retrieved cards, output, failures, passed, route and trace hash.

    model_output names a column of JSON outputs (from any source); where it is null or does not pass, the deterministic
    output takes its place.
    """
    screened = intake.evaluate(cases, strict=False)
    queries = screened.select(key, intake.query_text().alias("query"))
    scored = retrieval.term_scores(queries, cards, key, "card_id", "query", navigation.card_body(), F.col("title"))
    found = navigation.retrieve(screened, cards, key, scored, limit)
    known = known_keys(cards).agg(F.array_sort(F.collect_set("card_id")).alias("known_cards"))
    rows = found.crossJoin(F.broadcast(known))
    if model_output is not None:
        rows = validation.validate(rows.withColumn("output", F.col(model_output))).withColumnsRenamed({"passed": "model_passed", "failures": "model_failures"}).drop("output")
    made = navigation.deterministic_output(rows, "fallback")
    if model_output is None:
        made = made.withColumn("output", F.col("fallback")).withColumn("route", F.lit("canned_backend"))
    else:
        good = F.coalesce("model_passed", F.lit(False)) & F.col(model_output).isNotNull()
        made = made.withColumn("output", F.when(good, F.col(model_output)).otherwise(F.col("fallback")))
        made = made.withColumn("route", F.when(good, "live_model_generated").when(F.col(model_output).isNull(), "canned_backend").otherwise("validation_fallback"))
    checked = validation.validate(made.drop("fallback"))
    return checked.withColumn("trace_hash", stable_hash("output", "floor", "route", digits=16))
