"""The corpus verifier: a sound corpus without issues, and rows spoilt one way each."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_navigation import CASE, CASES, cards  # noqa: F401

from sievework.operators import replay, verifier
from sievework.plans.navigation import run_cases

NAMES = ("chest", "child", "fever_measured", "sleepy_child")
KEPT = ("floor", "fired", "retrieved", "known_cards", "chief_concern", "symptoms", "vitals", "setting", "patient_age", "pregnancy_status", "responder_note")


def digest(text):
    return hashlib.sha256(json.dumps(text).encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def made(spark, cards):  # noqa: F811
    """The harness's rows, and a sound corpus with its specs."""
    rows = run_cases(spark.createDataFrame([c for c in CASES if c[0] in NAMES], CASE), cards).cache()
    specs, corpus = {}, {}
    for r in rows.collect():
        out = json.loads(r.output)
        specs[r.case_id] = {"case_id": r.case_id, "dataset_version": "v1", "expected_red_flag_rule_ids": [f.rule_id for f in r.fired], "expected_source_card_ids": out["source_cards"][:1], "target_protocol_card_id": out["source_cards"][0], "expected_min_protocol_urgency": r.floor}
        corpus[r.case_id] = {"case_id": r.case_id, "category": "general", "version": "v1", "messages": [{"role": "user", "content": f"prompt {r.case_id}"}, {"role": "assistant", "content": r.output}], "metadata": {"prompt_hash": digest(f"prompt {r.case_id}"), "prompt_template_hash": "t", "teacher_label_mode": "harness_v1"}}
    harness_rows = rows.select(F.col("case_id").alias("base_case_id"), *KEPT, F.lit("{}").alias("intake"))
    return harness_rows, specs, corpus


def repair(corpus, base, scope, **changes):
    gold = json.loads(corpus[base]["messages"][1]["content"])
    fields = {"protocol_urgency": ["protocol_urgency"], "handoff_note_sbar": ["handoff_note_sbar"], "source_card_closure": ["source_cards", "candidate_protocol_pathways"], "schema": ["responder_plain_language_script", "safety_boundary"], "missing_observations": ["missing_info_to_collect", "next_observations_to_collect"]}.get(scope, [])
    prompt = f"Focused field repair only: {scope} {base}"
    row = {"case_id": f"{base}--repair-{scope}", "category": f"focused_repair:{scope}", "version": "v1", "messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": json.dumps({f: gold[f] for f in fields} | changes.pop("answer", {}))}], "metadata": {"task_type": "focused_repair", "base_case_id": base, "repair_scope": scope, "prompt_hash": digest(prompt)}}
    return row | {"metadata": row["metadata"] | changes}


def run(spark, made, rows, versions=("v1",)):
    harness_rows, specs, _ = made
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows, 1)], "position long, row string").repartition(3)
    known = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(specs.values())], "position long, spec string")
    harness = lambda d: d.join(harness_rows, "base_case_id").withColumns({"prompt": F.concat(F.lit("prompt "), "base_case_id"), "template_hash": F.lit("t")})
    prompts = lambda d: d.withColumn("repair_prompt", F.concat(F.lit("Focused field repair only: "), "scope", F.lit(" "), "base_case_id"))
    return verifier.verify(df, known, harness, prompts, versions), len(specs)


def kinds(verified):
    return {r.position: [i.type for i in r.issues] for r in verified.collect()}


def answer(row, **changes):
    out = json.loads(row["messages"][1]["content"]) | changes
    return row | {"messages": [row["messages"][0], {"role": "assistant", "content": json.dumps(out)}]}


def test_a_sound_corpus_has_no_issues(spark, made):
    corpus = made[2]
    rows = [*corpus.values(), *(repair(corpus, "chest", s) for s in ("protocol_urgency", "handoff_note_sbar", "schema", "missing_observations", "source_card_closure"))]
    verified, specs = run(spark, made, rows)
    assert kinds(verified) == {k: [] for k in range(1, len(rows) + 1)}
    told = verifier.summary(verified, specs).first()
    assert told.passed and told.rows == len(rows) and told.case_specs == 4 and told.issue_types == {} and told.issues_sample == []
    assert told.task_types == {"navigator_full": 4, "focused_repair": 5}


def test_every_issue(spark, made):
    corpus = made[2]
    chest = corpus["chest"]
    meta = lambda **changes: chest | {"metadata": chest["metadata"] | changes}
    spoilt = [
        (chest | {"case_id": "nobody"}, ["missing_case_spec"]),
        (chest | {"messages": chest["messages"][:1]}, ["messages_must_match_llama_cpp_user_assistant_shape"]),
        (chest | {"messages": [chest["messages"][0], {"role": "assistant", "content": "{"}]}, ["assistant_content_is_not_json"]),
        (answer(chest, responder_plain_language_script="<think>My teacher said so.</think>"), ["assistant_contains_visible_reasoning_tag", "assistant_contains_teacher_artifact"]),
        (answer(chest, intake_facts=[{"source": "rumour"}, {"fact": "x"}, "text", {"source": "protocol_card"}]), ["intake_fact_source_not_in_harness_schema"] * 2),
        (chest | {"messages": [{"role": "user", "content": "other"}, chest["messages"][1]]}, ["user_prompt_does_not_equal_harness_build_prompt"]),
        (answer(chest, protocol_urgency="routine"), ["validator_failed_under_harness", "expected_label_score_failed"]),
        (meta(prompt_hash="x"), ["metadata_prompt_hash_mismatch"]),
        (meta(prompt_template_hash="x", teacher_label_mode=None), ["metadata_prompt_template_hash_mismatch", "teacher_label_mode_does_not_record_harness_alignment"]),
        (repair(corpus, "chest", "schema", base_case_id="child", answer={"extra": 1}), ["focused_repair_output_keys_do_not_match_scope", "focused_repair_prompt_does_not_match_harness", "metadata_prompt_hash_mismatch"]),
        (repair(corpus, "chest", "handoff_note_sbar", answer={"handoff_note_sbar": {"situation": "other"}}), ["focused_repair_field_not_from_base_gold"]),
        (repair(corpus, "chest", "unknown"), ["focused_repair_previous_output_could_not_be_rebuilt"]),
        (repair(corpus, "chest", "schema", prompt_hash="x"), ["metadata_prompt_hash_mismatch"]),
    ]
    rows = [corpus["chest"], corpus["child"], *(r for r, _ in spoilt)]
    rows[0], rows[1] = rows[1], rows[0]
    # The last row of a case is its base row, so a sound one comes last.
    rows.append(corpus["chest"])
    verified, _ = run(spark, made, rows)
    found = kinds(verified)
    assert {k: sorted(v) for k, v in found.items()} == {1: [], 2: [], **{k: sorted(v) for k, (_, v) in enumerate(spoilt, 3)}, len(rows): []}
    told = verifier.summary(verified, 4, shown=6).first()
    assert not told.passed and told.issue_count == sum(len(v) for _, v in spoilt)
    assert told.issue_types["metadata_prompt_hash_mismatch"] == 3
    assert [(s.position, s.type) for s in told.issues_sample] == [(k, t) for k in sorted(found) for t in found[k]][:6]


def test_rows_without_their_base(spark, made):
    corpus = made[2]
    lone = repair(corpus, "chest", "schema")
    audited = lone | {"metadata": lone["metadata"] | {"v6_replay_audit": {"accepted": True}}}
    bare = audited | {"messages": [{"role": "user", "content": "repair"}, {"role": "assistant", "content": "{}"}]}
    assert kinds(run(spark, made, [lone, audited, bare])[0]) == {1: ["focused_repair_missing_base_row"], 2: [], 3: ["replay_focused_repair_output_empty", "replay_focused_repair_prompt_not_self_contained"]}


def test_policies_by_version(spark, made):
    corpus = made[2]
    rows = [corpus["chest"] | {"version": v} for v in ("v2", "v5", "v6", "v7", "v9_unasked")]
    rows.append(answer(rows[0], responder_plain_language_script="Give 5 mg of aspirin and discharge home."))
    found = kinds(run(spark, made, rows, ("v2", "v5", "v6", "v7"))[0])
    assert found[1] == [] == found[5]
    assert {f"v5_metadata_{x}" for x in ("dataset_version_missing", "training_focus_mismatch", "excluded_eval_case_ids_missing")} <= set(found[2])
    assert {f"v6_metadata_{x}" for x in ("training_focus_mismatch", "policy_version_missing", "required_observation_targets_missing", "harness_cues_missing")} <= set(found[3])
    assert not any("metadata_" in t for t in found[4]) and any(t.startswith("v6_") for t in found[4])
    assert "v2_forbidden_lexical_tripwire" in found[6]


def test_compiled_checks_stop(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    checks = [verifier.Check("one", F.col("x") >= 2), verifier.Check("stop", F.col("x") == 2, stops=True), verifier.Check("each", F.array(F.col("x").cast("string"), F.lit("y")), condition=False)]
    found = {r.x: [(i.type, i.detail) for i in r.i] for r in df.withColumn("i", verifier.compiled(checks)).collect()}
    each = lambda x: [("each", str(x)), ("each", "y")]
    assert found == {1: each(1), 2: [("one", None), ("stop", None)], 3: [("one", None), *each(3)]}
    assert set(replay.SCOPES) >= {"schema"}
