"""The registered queries over the driver tables, each an operator of the library at work on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import severity, text
from sievework.functions.hashing import row_hash
from sievework.functions.sets import missing
from sievework.operators import audit, decontaminate, merging, metrics, provenance, redaction, retrieval, screening, selection
from sievework.plans import dims
from sievework.sources.cuts import cut
from sievework.sources.tables import fixed, read_table

NEAR, EXCLUDE, COVER, CONTAIN = 0.92, 0.5, 0.5, 0.9
TOP = 10


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(_t(spark, sf_dir, "documents"), F.lower("text"), dims.RULES)


def q01_rule_hits(spark, sf_dir):
    return screening.rule_rows(_screened(spark, sf_dir), "doc_id").select("doc_id", "rule_id", "severity", "check_ordinal")


def q02_rule_first_evidence(spark, sf_dir):
    return screening.rule_rows(_screened(spark, sf_dir), "doc_id").select("doc_id", "rule_id", "evidence", "card_id")


def q03_severity_floor(spark, sf_dir):
    return _screened(spark, sf_dir).select("doc_id", screening.floor(F.col("fired")).alias("floor"))


def q04_floor_histogram(spark, sf_dir):
    return _screened(spark, sf_dir).groupBy("lang", screening.floor(F.col("fired")).alias("floor")).agg(F.count("*").alias("n"))


def q05_forbidden_phrase_scan(spark, sf_dir):
    low = F.lower("text")
    found = F.array(*(F.struct(F.lit(i).alias("pattern"), screening.first_match(low, (p,)).alias("found")) for i, p in enumerate(dims.FORBIDDEN)))
    return _t(spark, sf_dir, "documents").select("doc_id", F.inline_outer(F.filter(found, lambda x: x["found"].isNotNull()))).where("found IS NOT NULL")


def q06_clause_negation(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(screening.clauses(F.col("text"))).alias("clause")).where("clause IS NOT NULL")
    cues = F.array(*(F.struct(F.lit(c).alias("cue"), screening.negated_clause(F.col("clause"), c, dims.MARKERS).alias("negated")) for c in dims.CUES))
    hits = docs.select("doc_id", "clause", F.inline(cues)).where(F.contains("clause", "cue"))
    return hits.groupBy("doc_id", "cue").agg(F.count("*").alias("hits"), F.count_if("negated").alias("negated"))


def q07_age_parse(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, dims.AGE_UNITS)), (F.col("o_orderkey") % len(dims.AGE_UNITS)).cast("int"))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat((F.col("o_orderkey") % 300).cast("string"), F.lit(" "), unit).alias("age"))
    return rows.select("id", text.age_in_years(F.col("age")).alias("age_years"), text.is_minor(F.col("age")).alias("is_minor"))


def q08_generic_line_ratio(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    rows = _t(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    generic = F.size(F.filter("l", lambda x: F.size(text.words(x)) <= 3))
    return rows.select("doc_id", F.size("l").alias("lines"), generic.alias("generic"), (generic >= F.greatest(F.lit(3), F.floor(F.size("l") / 2).cast("int"))).alias("dominated"))


def q09_query_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.query_terms(F.col("text"))).alias("ordinal", "term"))


def q10_term_score_topk(spark, sf_dir):
    return retrieval.best_by_terms(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), "item_id", "doc_id", "text", F.col("text"), TOP, F.col("source"))


def _bm25(spark, sf_dir, queries):
    return retrieval.best_by_bm25(queries, _t(spark, sf_dir, "documents"), "item_id", "doc_id", "text", F.col("text"), TOP)


def q11_bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, _t(spark, sf_dir, "benchmark"))


def q12_retrieval_fallback(spark, sf_dir):
    queries = _t(spark, sf_dir, "benchmark").unionByName(fixed(spark, dims.EXTRA_QUERIES, "item_id", "text"))
    first = cut(_bm25(spark, sf_dir, queries).select("item_id", "doc_id"), "first-engine")
    # The second engine is asked only what the first gave nothing for.
    rest = queries.join(first, "item_id", "left_anti")
    second = retrieval.best_by_terms(rest, _t(spark, sf_dir, "documents"), "item_id", "doc_id", "text", F.col("text"), TOP).select("item_id", "doc_id")
    rows = retrieval.with_fallback(first, second, queries, "item_id", ("bm25", "substring"))
    return retrieval.source_summary(rows, queries, "item_id")


def q13_forced_then_ranked(spark, sf_dir):
    ranked = q11_bm25_topk(spark, sf_dir)
    required = _t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("ordinal", "doc_id"))
    return retrieval.forced_first(ranked, required, "item_id", "doc_id", 6)


def q14_provenance_counts(spark, sf_dir):
    return metrics.provenance_counts(_t(spark, sf_dir, "events"), "event_type")


def q15_provenance_by_field(spark, sf_dir):
    return metrics.provenance_by_field(_t(spark, sf_dir, "events"), F.pmod("user_id", F.lit(8)), "event_type", ("click", "error", "purchase", "signup", "view"))


def _labelled(spark, sf_dir):
    return _screened(spark, sf_dir).join(_t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("floor", screening.floor(F.col("fired")))


def q16_eval_counters(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return metrics.counters(
        rows,
        labelled=F.col("quality").isNotNull(),
        good=F.col("quality") == 1,
        toxic=F.col("toxic") == 1,
        caught=(F.col("toxic") == 1) & (F.size("fired") > 0),
        urgent=severity.at_least(F.col("floor"), F.lit("urgent")),
    )


def _checked(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    known = F.col("quality").isNotNull()
    return rows.select(
        "doc_id",
        F.when(known, F.col("quality") == 1).alias("quality_ok"),
        F.when(known, F.col("toxic") == 0).alias("clean"),
        F.when(known, F.col("n_chars") >= 500).alias("long_enough"),
        F.when(F.col("toxic") == 1, F.exists("fired", lambda r: r["card_id"] == "ABUSE-CARD")).alias("toxic_caught"),
        severity.meets_expected(F.col("floor"), F.when(F.col("toxic") == 1, F.lit("urgent"))).alias("floor_met"),
    )


CHECKS = ["quality_ok", "clean", "long_enough", "toxic_caught", "floor_met"]


def q17_three_valued_checks(spark, sf_dir):
    return metrics.tally_checks(_checked(spark, sf_dir), CHECKS)


def q18_all_checks_flag(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", metrics.all_applicable(*map(F.col, CHECKS)).alias("all_passed"))


def _sets(spark, sf_dir):
    docs = decontaminate.token_sets(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    items = decontaminate.token_sets(_t(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return docs, items


def q19_cue_coverage(spark, sf_dir):
    docs, items = _sets(spark, sf_dir)
    found = decontaminate.overlaps(docs, items, "doc_id", "item_id", COVER)
    return found.select("doc_id", "item_id", (F.col("n_item") - F.col("common")).alias("n_missing"))


def q20_missing_cue_counts(spark, sf_dir):
    docs, items = _sets(spark, sf_dir)
    return metrics.value_counts(decontaminate.overlaps(docs, items, "doc_id", "item_id", COVER, lacking=True), "missing", "token")


def q21_latency_summary(spark, sf_dir):
    return metrics.latency_summary(_t(spark, sf_dir, "events"), "value", "event_type")


def q22_error_marker_scan(spark, sf_dir):
    return metrics.error_markers(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"), dims.ERRORS)


def q23_spec_join(spark, sf_dir):
    specs = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    found = merging.lookup(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), specs, F.col("l_orderkey"), "o_orderkey")
    return found.groupBy("l_returnflag").agg(F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("unmatched"))


def q24_orphans_both_ways(spark, sf_dir):
    found = merging.orphans(_t(spark, sf_dir, "orders"), "o_orderkey", _t(spark, sf_dir, "lineitem").where("l_quantity > 10"), "l_orderkey")
    return found.groupBy("side").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def q25_semi_needed(spark, sf_dir):
    needed = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = _t(spark, sf_dir, "orders")
    kept = orders.join(needed, orders.o_orderkey == needed.l_orderkey, "left_semi")
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def q26_last_writer_wins(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return merging.last_writer("key", customers, suppliers)


def q27_duplicate_ids(spark, sf_dir):
    return merging.duplicates(_t(spark, sf_dir, "documents"), decontaminate.content_key(F.col("text")).alias("content"))


def q28_strided_shards(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy(selection.shard_of(F.col("o_orderkey"), 7).alias("shard"))
    return rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def _split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return selection.stratified_split(docs, "doc_id", ["lang", "source"], dims.SPLIT_FRACTION, dims.SPLIT_SEED, dims.SPLIT_GROUP)


def q29_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "split")


def q30_split_manifest(spark, sf_dir):
    groups = _split(spark, sf_dir).groupBy("lang", "source")
    return groups.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"))


def _quota(spark, sf_dir, fill):
    targets = spark.createDataFrame(list(dims.QUOTAS), "p_brand string, target int")
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return selection.quota_select(parts, targets, "p_brand", [F.desc("p_size"), F.col("p_partkey")], fill, [F.desc("p_size"), F.col("p_partkey")]), targets


def q31_quota_select(spark, sf_dir):
    return _quota(spark, sf_dir, False)[0].select("p_partkey", "p_brand", "place")


def q32_quota_fill_and_shortage(spark, sf_dir):
    chosen, targets = _quota(spark, sf_dir, False)
    return selection.shortages(chosen, targets, "p_brand")


def q32_quota_fill(spark, sf_dir):
    return _quota(spark, sf_dir, True)[0].select("p_partkey", "reason")


def _segments(spark, sf_dir, count):
    """The market segments, in name order, with their customers as `count`."""
    found = _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias(count))
    return found.withColumn("ordinal", F.row_number().over(Window.orderBy("class")))


def q33_weighted_schedule(spark, sf_dir):
    return selection.weighted_schedule(_segments(spark, sf_dir, "target"), "class", "ordinal")


def q33_apportioned_targets(spark, sf_dir):
    return selection.apportion(_segments(spark, sf_dir, "weight"), "class", "ordinal", 97)


def q34_cumulative_slot_class(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(selection.slot_class(F.col("o_orderkey"), list(dims.SLOTS)).alias("class")).agg(F.count("*").alias("n"))


def q35_exact_content_neighbor(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", decontaminate.content_key(F.col("text")).alias("content"))
    first = docs.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "content").where("doc_id > first_id").select("doc_id", "first_id")


def _sets_by_lang(spark, sf_dir):
    return decontaminate.token_sets(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"), "lang")


def q36_near_neighbor_jaccard(spark, sf_dir):
    found = decontaminate.classes(_sets_by_lang(spark, sf_dir), "doc_id", "lang")
    return decontaminate.similar_pairs(found.drop("members"), "class_id", NEAR, "lang").select("a", "b", F.round("similarity", 6).alias("similarity"))


def q36_token_set_classes(spark, sf_dir):
    return decontaminate.members(_sets_by_lang(spark, sf_dir), "doc_id", "lang")


def q37_first_exclusion_match(spark, sf_dir):
    keyed = lambda name, key: decontaminate.token_sets(_t(spark, sf_dir, name).withColumn("content", decontaminate.content_key(F.col("text"))), key, F.col("text"), "content")
    matches = decontaminate.exclusion_matches(keyed("documents", "doc_id"), keyed("benchmark", "item_id"), "doc_id", "item_id", EXCLUDE)
    return decontaminate.first_exclusion(matches, "doc_id", "item_id")


def q38_contamination_containment(spark, sf_dir):
    docs, items = _sets(spark, sf_dir)
    found = decontaminate.contained_items(docs, items, "doc_id", "item_id", CONTAIN)
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def q39_precedence_merge(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = _t(spark, sf_dir, "labels").withColumn("has_label", F.lit(True))
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("chars"), F.lit(True).alias("has_item"))
    rows = docs.join(labels, "doc_id", "left").join(items, "doc_id", "left")
    merged = provenance.merge_by_presence(
        F.col("chars").cast("long"), F.col("quality").cast("long"), F.col("n_chars"), F.col("toxic") == 0,
        F.coalesce("has_item", F.lit(False)), F.coalesce("has_label", F.lit(False)),
    )
    return rows.select("doc_id", merged.alias("m")).select("doc_id", "m.value", "m.provenance")


def q40_final_route(spark, sf_dir):
    kind = F.col("event_type")
    route = provenance.route(kind != "signup", kind != "error", F.pmod("user_id", F.lit(3)) == 0, F.col("value") > 10)
    return _t(spark, sf_dir, "events").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def q41_best_candidate(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    order = [F.desc(F.col("l_returnflag") == "N"), F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")]
    return selection.best_by(lines, "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_partkey")


def q42_label_diff(spark, sf_dir):
    before = _t(spark, sf_dir, "labels")
    flagged = F.exists("fired", lambda r: r["card_id"] == "ABUSE-CARD").cast("int")
    after = _screened(spark, sf_dir).where("n_chars >= 300").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("quality"), flagged.alias("toxic"))
    changes = merging.label_diff(before, after, "doc_id", ["quality", "toxic"])
    return changes.groupBy("label", "before", "after").agg(F.count("*").alias("n"))


def q43_set_differences(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    kinds = events.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") < 3, F.col("event_type"))).alias("expected"), F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("actual")
    )
    joined = lambda a, b: F.array_join(missing(F.col(a), F.col(b)), ",")
    return kinds.select("user_id", joined("expected", "actual").alias("missing"), joined("actual", "expected").alias("unexpected"))


def _audited(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("n_words", F.size(text.words(F.col("text"))))
    conditions = [
        ("unlabelled", F.col("quality").isNull()),
        ("low_quality", F.col("quality") == 0),
        ("toxic", F.col("toxic") == 1),
        ("rule_fired", F.size("fired") > 0),
        ("too_short", F.col("n_words") < 50),
        ("symbols", F.regexp_count("text", F.lit(r"[#$%&*]")) > 10),
    ]
    found = audit.reasons(rows, conditions)
    score = 100 - 15 * F.size("reasons") + F.when(severity.at_least(F.col("floor"), F.lit("urgent")), -20).otherwise(0)
    return found.withColumn("score", score.cast("int"))


def q44_replay_audit_reasons(spark, sf_dir):
    return audit.issue_tally(_audited(spark, sf_dir), "reasons")


def q44_replay_score_histogram(spark, sf_dir):
    return _audited(spark, sf_dir).groupBy("score", (F.size("reasons") == 0).alias("accepted")).agg(F.count("*").alias("n"))


def q45_chat_shape_contract(spark, sf_dir):
    shapes = audit.conversation_shape(_t(spark, sf_dir, "conversations"))
    found = audit.chat_contract(shapes, ("user", "assistant", "system"), ("user", "system"), "assistant")
    return found.select("conv_id", F.size("roles").alias("n_turns"), F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("")).alias("reason"))


def q46_role_filter_with_reasons(spark, sf_dir):
    drops = [("system_role", F.col("role") == "system"), ("too_short", F.length("text") < 60), ("no_letters", ~F.lower("text").rlike("[a-z]"))]
    return redaction.drop_summary(redaction.keep_or_drop(_t(spark, sf_dir, "conversations"), drops))


def q47_redact_secrets(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(redaction.redact(F.col("text")), 256).alias("redacted_sha256"), redaction.hits(F.col("text")).cast("int").alias("n_hits"))


def q48_claim_line_scan(spark, sf_dir):
    lines = audit.lines_of(_t(spark, sf_dir, "documents"), "doc_id", "text")
    proven = spark.createDataFrame([(g,) for g in dims.PROVEN], "gate string")
    return audit.claim_hits(lines, dims.GATES, proven).select("doc_id", "line_no", "gate")


def q49_gate_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return audit.gate_rollup(
        rows, has_text=F.length("text") > 0, char_count=F.length("text") == F.col("n_chars"), labelled=F.col("quality").isNotNull(), no_toxic=F.coalesce(F.col("toxic"), F.lit(0)) == 0
    )


def q50_row_hash_manifest(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return audit.hash_manifest(docs, "source", "doc_id", row_hash(*map(F.col, ("doc_id", "lang", "source", "n_chars", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}
