"""Registered queries of curation: row numbers, attempts, repair rounds, replay audits, issue summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators import numbering, output_policies, recovery, replay, selection, verifier
from sievework.plans.queries import _t

#: What the rows of q82 observe; each stands in turn.
OBSERVED = ("monitor closely", "Repeat-Vitals", "source card IDs now", "give a dose", "navigator validation result", "follow up ", "pulse", "skin", "send home", "check_up", "collect  more information", "y")
LINES = 4


def q78_row_numbers(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return numbering.number_rows(rows, "source", "lang", F.desc("doc_id")).select("doc_id", "row_number")


def q79_zipped_positions(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    suppliers = _t(spark, sf_dir, "supplier").select("s_suppkey")
    return numbering.zip_rows(customers, suppliers, ["c_acctbal", "c_custkey"], ["s_suppkey"], how="full").select("position", "c_custkey", "s_suppkey")


def q80_numbered_cases(spark, sf_dir):
    return numbering.numbered_cases(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "case-", F.desc("p_size"), "p_partkey", width=3).select("p_partkey", "case_id")


def q81_attempts_until(spark, sf_dir):
    """Orders as attempts for their customers, until half of the customers have one."""
    wanted = _t(spark, sf_dir, "customer").count() // 2
    reason = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_totalprice") < 100_000, "small")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", reason.alias("reason"))
    found = selection.accept_until(orders, "o_custkey", "o_orderkey", "reason", wanted)
    kept = found.accepted.groupBy(F.lit("accepted").alias("outcome")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
    return kept.unionByName(found.rejections.select(F.col("reason").alias("outcome"), "n", F.lit(0).cast("long").alias("key_sum"))).withColumn("made", F.lit(found.made).cast("long"))


def _replay_rows(spark, sf_dir):
    d = F.col("doc_id")
    at = lambda n: F.get(F.array(*map(F.lit, OBSERVED)), F.pmod(n, F.lit(len(OBSERVED))).cast("int"))
    every = lambda n: d % n == 0
    more = F.when(every(5), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    missing = F.concat(F.array(at(d)), more)
    answer = F.to_json(
        F.struct(
            missing.alias("missing_info_to_collect"), F.when(every(2), missing).otherwise(F.array(at(F.floor(d / 12)))).alias("next_observations_to_collect"),
            F.concat(F.substring("text", 1, 20), F.when(every(13), " Teacher").when(every(17), "<think").otherwise("")).alias("note"), F.when(every(3), F.lit("urgent")).alias("protocol_urgency"),
            F.when(every(6), F.array(F.lit("a"), F.lit("b"))).alias("selected_required_observation_ids"),
            F.when(every(4), F.array(F.lit("SAFETY-BOUNDARIES-v1"), F.lit("REFERRAL-SBAR-v1"), F.lit("STROKE-SIGNS-v1"))).otherwise(F.array(F.lit("STROKE-SIGNS-v1"))).alias("source_cards"),
            F.when(every(7), F.struct(F.lit("s").alias("situation"))).alias("handoff_note_sbar"), F.when(d % 6 == 3, F.lit("Follow the Local Protocol")).alias("safety_boundary"),
        )
    )
    metadata = F.struct(
        F.when(every(11), False).alias("validator_passed"), F.struct(F.when(every(19), False).alias("all_expected_labels_passed")).alias("expected_label_score"),
        F.when(every(12), F.array(F.lit("c"))).alias("must_include_selected_required_observation_ids"), F.when(every(9), F.array(F.lit("next_observations_to_collect"))).alias("deterministic_scaffold_patched_fields"),
        F.when(every(10), F.array(F.lit("FEVER-RED-FLAGS-v1"))).alias("must_include_source_cards"),
    )
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    category = F.when(d % 3 == 0, "required_observation_id_selection").when(d % 3 == 1, "radio_handoff")
    row = F.struct(category.alias("category"), F.array(turn("user", F.lit("q")), turn("assistant", F.when(every(29), "{").otherwise(answer))).alias("messages"), metadata.alias("metadata"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.to_json(row).alias("row"))


def q82_replay_audit(spark, sf_dir):
    found = replay.replay_audit(_replay_rows(spark, sf_dir))
    return found.select("doc_id", "category", "task_type", F.array_join("reasons", ",").alias("reasons"), "score", "accepted")


def q83_replay_audit_with_closure(spark, sf_dir):
    found = replay.replay_audit(_replay_rows(spark, sf_dir), closure=True)
    return found.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "score")


def q84_corrupted_outputs(spark, sf_dir):
    scopes = F.array(*map(F.lit, (*replay.SCOPES, "unknown")))
    scope = F.get(scopes, F.pmod("o_orderkey", F.size(scopes)).cast("int"))
    output = F.to_json(F.struct(F.lit("urgent").alias("protocol_urgency"), F.array(F.lit("SAFETY-BOUNDARIES-v1"), F.concat(F.lit("C"), F.col("o_custkey"))).alias("source_cards"), F.col("o_orderpriority").alias("safety_boundary")))
    floor = F.when(F.col("o_orderstatus") == "F", "routine").otherwise("urgent")
    return _t(spark, sf_dir, "orders").select("o_orderkey", scope.alias("scope"), replay.corrupted(output, scope, floor).alias("broken"))


def q85_repair_assignment(spark, sf_dir):
    """Customers as turns of their segment's scope, parts as base rows that fit one scope or two."""
    schedule = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("scope"))
    names = F.array_sort(F.array_distinct(F.collect_list("scope")))
    scopes = schedule.agg(names.alias("scopes")).select(F.posexplode("scopes").alias("k", "scope"))
    parts = _t(spark, sf_dir, "part").select("p_partkey").join(F.broadcast(scopes), F.pmod(F.col("p_partkey") + F.col("k"), F.lit(3)) == 0)
    eligible = parts.select("scope", F.concat(F.col("p_partkey"), F.lit("--repair-"), "scope").alias("candidate"), F.col("p_partkey").alias("ordinal"))
    taken = eligible.where("ordinal % 17 = 0").select("candidate")
    return replay.assign_repairs(schedule, eligible, taken).select("position", "scope", "candidate")


def q86_repair_rounds(spark, sf_dir):
    """Orders as records, their first lines as turns with a model that answers, fails, or leaves out a card."""
    scope = F.when(F.col("l_partkey") % 3 == 0, "citations_and_pathways").when(F.col("l_partkey") % 3 == 1, "handoff_note_sbar").otherwise("protocol_urgency")
    card = lambda n: F.concat(F.lit("CARD-"), F.pmod(n, F.lit(3)), F.lit("-v1"))
    lines = _t(spark, sf_dir, "lineitem").withColumn("turn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    reply = F.to_json(F.struct(F.col("l_linestatus").alias("protocol_urgency"), F.array(card(F.col("l_quantity").cast("int"))).alias("source_cards"), F.col("l_returnflag").alias("handoff_note_sbar")))
    lines = lines.select(
        F.col("l_orderkey").alias("id"), "turn", scope.alias("scope"), F.when(F.col("l_suppkey") % 5 == 0, None).when(F.col("l_suppkey") % 5 == 1, "[]").otherwise(reply).alias("told"),
        F.when(F.col("l_partkey") % 3 == 0, F.array(card(F.col("l_suppkey")))).otherwise(F.array().cast("array<string>")).alias("cards"),
    )
    own = F.when(F.col("scope") == "citations_and_pathways", F.array(F.lit("source_cards"), F.lit("candidate_protocol_pathways"))).otherwise(F.array("scope"))
    turns = lines.where(F.col("turn") <= LINES).withColumn("fields", own)
    records = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("{}").alias("output"))
    found = recovery.repair_rounds(records, turns, "id", lambda d: d.withColumnRenamed("told", "reply"), cap=2)
    value = lambda field: F.try_element_at("repaired", F.lit(field)).alias(field)
    return found.select("id", "scope_count", "capped", "attempts", F.array_join("events", "; ").alias("events"), *map(value, ("protocol_urgency", "source_cards", "handoff_note_sbar")))


def q87_settled_outputs(spark, sf_dir):
    """Orders as failed outputs of three fields: the first merge that its check lets pass, with where each field came from."""
    failures = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("protocol_urgency is missing or invalid"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("handoff_note_sbar is missing: background"), F.lit("unknown source_cards: X"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("forbidden clinical language: dose"))).otherwise(F.array(F.lit("odd")))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    repaired = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("protocol_urgency"), text(F.col("o_orderpriority")))).otherwise(F.create_map().cast("map<string,string>"))
    raw = F.to_json(F.struct(F.lit("raw").alias("protocol_urgency"), F.array(F.lit("R")).alias("source_cards"), F.when(F.col("o_orderstatus") != "P", F.lit("raw note")).alias("handoff_note_sbar")))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), failures.alias("failures"), repaired.alias("repaired"), raw.alias("raw"), F.lit('{"protocol_urgency":"routine","source_cards":[],"handoff_note_sbar":null}').alias("fallback"))
    # The check stands for a validator: an urgency of the lowest priorities is not valid.
    check = lambda d: d.withColumns({"failures": F.array().cast("array<string>"), "passed": ~F.get_json_object("output", "$.protocol_urgency").rlike("^[45]-")})
    fields = ("protocol_urgency", "source_cards", "handoff_note_sbar")
    found = recovery.settle(rows, "id", check, raw="raw", fields=fields)
    return found.select("id", "output", "event", *(F.try_element_at("provenance", F.lit(f)).alias(f"of_{f}") for f in fields))


def q88_issue_summary(spark, sf_dir):
    """Documents under a registry of checks, one of which ends a row's checks: counts by type and the first issues by place."""
    checks = [
        verifier.Check("empty", F.length("text") == 0, stops=True),
        verifier.Check("short", F.size(F.split("text", " ")) < 30, stops=True),
        verifier.Check("other_language", F.col("lang") != "en"),
        verifier.Check("license_line", F.transform(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike("licen[sc]ed?")), lambda x: F.substring(x, 1, 20)), condition=False),
    ]
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.concat(F.lit("case-"), "doc_id").alias("case_id"), F.col("source").alias("category"), F.col("lang").alias("task_type"), verifier.compiled(checks).alias("issues"))
    told = verifier.summary(rows, 0)
    entries = lambda kind: F.transform(F.map_entries(kind), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("n"), F.lit(None).cast("long").alias("position")))
    sample = F.transform("issues_sample", lambda s: F.struct(F.lit("sample").alias("kind"), F.concat_ws(" ", s["type"], s["detail"]).alias("name"), F.lit(1).cast("long").alias("n"), s["position"].alias("position")))
    totals = F.array(F.struct(F.lit("issues").alias("kind"), F.lit("all").alias("name"), F.col("issue_count").alias("n"), F.lit(None).cast("long").alias("position")))
    return told.select(F.inline(F.concat(entries("issue_types"), entries("categories"), sample, totals)))


#: What the outputs of q89 say and observe; each stands in turn.
SAID = ("diagnosed now", "prescribing it", "give 5 mg", "inject now", "aspirin", "send them home", "calm words", "rest")
ASKED = ("repeat vitals", "monitor closely", "follow protocol", "assess the patient", "pulse", "skin")


def q89_policy_issues(spark, sf_dir):
    """Issues of policy v3 of outputs made from documents, so that every rule has rows that break it and rows that keep it."""
    d = F.col("doc_id")
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))
    every = lambda n: d % n == 0
    none = F.array().cast("array<string>")
    slot = lambda short: F.when(short, "s").otherwise("said in full")
    output = F.struct(
        F.when(every(11), "urgent").otherwise("routine").alias("protocol_urgency"), F.when(every(7), F.array(F.struct(F.lit("R").alias("rule_id")))).otherwise(F.array().cast("array<struct<rule_id:string>>")).alias("red_flags"),
        F.when(every(2), F.array(F.struct(F.lit("SAFETY-BOUNDARIES-v1").alias("card_id")))).otherwise(F.array().cast("array<struct<card_id:string>>")).alias("candidate_protocol_pathways"),
        F.array(*(of(ASKED, d + k) for k in range(3))).alias("missing_info_to_collect"),
        F.when(every(5), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("x"), k))).otherwise(F.array(of(ASKED, d + 3))).alias("next_observations_to_collect"),
        F.struct(slot(every(4)).alias("situation"), slot(every(9)).alias("background"), slot(every(9)).alias("assessment_observations_only"), slot(F.lit(False)).alias("handoff_request")).alias("handoff_note_sbar"),
        F.concat(F.substring("text", 1, 30), F.lit(" "), of(SAID, d)).alias("responder_plain_language_script"),
    )
    rows = _t(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(output).alias("output"), of(("negation_safety_boundary", "radio_handoff", "plain"), d).alias("failure_class"), none.alias("expected_flags"), F.array(F.lit("SAFETY-BOUNDARIES-v1")).alias("expected_pathways"),
        F.when(every(13), '{"available_supplies":"no pulse oximeter"}').otherwise("{}").alias("intake"), F.array().cast("array<struct<card_id:string>>").alias("fired"),
        F.array().cast("array<struct<card_id:string,required_observations:array<string>>>").alias("retrieved"), F.lit("").alias("target_card"),
    )
    found = output_policies.with_policy_issues(rows, "v3")
    return found.select("doc_id", F.explode_outer("issues").alias("issue")).where("issue IS NOT NULL")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}
