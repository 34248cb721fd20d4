"""Replay audits and repair assignment against loops over rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import replay

SAFETY, NOTE = "SAFETY-BOUNDARIES-v1", "REFERRAL-SBAR-v1"


def norm(text):
    return " ".join(text.lower().replace("-", " ").replace("_", " ").split())


def strings(value):
    return [str(x).strip() for x in value if str(x).strip()] if isinstance(value, list) else []


def audit(row, closure):
    meta = row.get("metadata") or {}
    category = row.get("category") or meta.get("category") or meta.get("failure_class") or "missing"
    try:
        out = json.loads(row["messages"][-1]["content"])
    except (ValueError, KeyError, IndexError, TypeError):
        out = None
    if not isinstance(out, dict):
        return False, ["assistant_content_not_json"], 0
    task = meta.get("task_type") or ("navigator_full" if "protocol_urgency" in out else "focused_repair")
    text = json.dumps(out).lower()
    a, b = strings(out.get("missing_info_to_collect")), strings(out.get("next_observations_to_collect"))
    items = [norm(x) for x in a + b]
    chosen, must = strings(out.get("selected_required_observation_ids")), strings(meta.get("must_include_selected_required_observation_ids"))
    score, reasons = replay.PRIORITY.get(category, 20), []
    for holds, name in (
        (meta.get("validator_passed") is False, "validator_failed"),
        ((meta.get("validation_result") or {}).get("passed") is False, "validation_result_failed"),
        ((meta.get("expected_label_score") or {}).get("all_expected_labels_passed") is False, "expected_labels_failed"),
        ((meta.get("expected_label_score") or {}).get("forbidden_behavior_absent") is False, "forbidden_behavior_present"),
        ("teacher" in text, "teacher_artifact"),
        ("<think" in text or "</think" in text, "visible_reasoning_tag"),
        (len(a) > 3 and a == b, "duplicate_long_missing_and_next_observations"),
        *((any(norm(p) in x for x in items), "harness_metadata_observation:" + p.replace(" ", "_")) for p in replay.HARNESS_PHRASES),
        *((norm(p) in items, "generic_observation_phrase:" + p.replace(" ", "_")) for p in replay.GENERIC_PHRASES),
        *((any(p in x for x in items), "unsafe_observation_fragment:" + p.replace(" ", "_")) for p in replay.UNSAFE_FRAGMENTS),
        (task == "navigator_full" and category in replay.OBSERVATION_CATEGORIES and not chosen, "observation_focused_row_missing_selected_required_observation_ids"),
        (bool(strings(meta.get("invalid_selected_required_observation_ids"))), "invalid_selected_required_observation_ids"),
        (bool(chosen) and bool(set(must) - set(chosen)), "selected_required_observation_ids_missing_required"),
    ):
        reasons += [name] if holds else []
    score += -20 * bool({"missing_info_to_collect", "next_observations_to_collect"} & set(strings(meta.get("deterministic_scaffold_patched_fields")))) + 10 * bool(chosen) + 15 * (task == "focused_repair") + 25 * (not reasons)
    if closure:
        cards = strings(out.get("source_cards"))
        if task == "navigator_full":
            target = next((c for c in strings(meta.get("must_include_source_cards")) + cards if c in replay.CLINICAL_CARDS), None)
            spoken = json.dumps([out.get(k) for k in ("safety_boundary", "do_not_do", "responder_plain_language_script")]).lower()
            reasons += [f"missing_target_source_card:{target}"] if target and target not in cards else []
            reasons += ["missing_referral_sbar_source_card"] if out.get("handoff_note_sbar") and NOTE not in cards else []
            reasons += ["missing_safety_boundaries_source_card"] if "local protocol" in spoken and SAFETY not in cards else []
        score += 15 * ({SAFETY, NOTE} <= set(cards)) + 8 * (3 <= len(cards) <= 5) + 5 * (task == "navigator_full") + 25 * (not reasons)
    return not reasons, reasons, score


def rows():
    rng = random.Random(12)
    pick = lambda *xs: rng.choice(xs)
    out = []
    for _ in range(300):
        items = lambda: rng.sample(["pulse", "skin", "Monitor-closely", "source card IDs now", "give a dose", "follow up", "repeat  vitals", " ", "x y"], rng.choice((0, 1, 1, 4)))
        first = items()
        answer = {"missing_info_to_collect": first, "next_observations_to_collect": pick(first, items()), "source_cards": rng.sample([SAFETY, NOTE, "STROKE-SIGNS-v1", "OTHER-v1"], rng.randint(0, 4))}
        answer |= pick({}, {"protocol_urgency": "urgent"}, {"protocol_urgency": None}) | pick({}, {"selected_required_observation_ids": ["a", "b"]}) | pick({}, {"note": "Teacher said"}, {"note": "a</THINK>"}, {})
        answer |= pick({}, {"handoff_note_sbar": {}}, {"handoff_note_sbar": {"situation": "s"}}) | pick({}, {"do_not_do": ["Follow Local Protocol"]})
        meta = pick({}, {"validator_passed": False}, {"validator_passed": True}, {"validation_result": {"passed": False}}) | pick({}, {"expected_label_score": {"all_expected_labels_passed": False, "forbidden_behavior_absent": False}})
        meta |= pick({}, {"task_type": "focused_repair"}, {"task_type": "navigator_full"}) | pick({}, {"must_include_selected_required_observation_ids": ["a", "c"]}) | pick({}, {"invalid_selected_required_observation_ids": ["z"]}, {})
        meta |= pick({}, {"deterministic_scaffold_patched_fields": ["missing_info_to_collect"]}) | pick({}, {"must_include_source_cards": ["x", "STROKE-SIGNS-v1"]})
        row = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": pick(json.dumps(answer), json.dumps(answer), json.dumps(answer), "[]", "{")}], "metadata": meta}
        out.append(row | pick({}, {"category": ""}, {"category": "schema"}, {"category": "radio_handoff"}, {"category": "required_observation_id_selection"}))
    return [*out, {}, {"messages": []}, {"messages": [{"role": "assistant", "content": None}]}, {"messages": [{"role": "assistant", "content": '{"a": 1}'}], "metadata": None}]


@pytest.mark.parametrize("closure", [False, True])
def test_audit_like_a_loop(spark, closure):
    made = rows()
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(made)], "id long, row string").repartition(3)
    seen = set()
    for r in replay.replay_audit(df, closure=closure).collect():
        assert (r.accepted, r.reasons, r.score) == audit(made[r.id], closure), made[r.id]
        seen |= set(r.reasons)
    assert len(seen) > 14


def test_corrupted_outputs(spark):
    gold = {"protocol_urgency": "urgent", "source_cards": [SAFETY, "PED-DEHYD-RED-FLAGS-v1"], "safety_boundary": "s", "responder_plain_language_script": "r", "do_not_do": ["x"], "n": {"deep": [1, None]}}
    cases = [(s, f) for s in (*replay.SCOPES, "unknown", None) for f in ("routine", "urgent")]
    df = spark.createDataFrame([(s, f, json.dumps(gold)) for s, f in cases], "scope string, floor string, output string")
    found = {(r.scope, r.floor): r.c and json.loads(r.c) for r in df.select("scope", "floor", replay.corrupted(F.col("output"), F.col("scope"), F.col("floor")).alias("c")).collect()}
    assert found["protocol_urgency", "routine"] is None and found["unknown", "urgent"] is None and found[None, "urgent"] is None
    assert found["protocol_urgency", "urgent"] == gold | {"protocol_urgency": "routine"}
    assert found["missing_observations", "urgent"] == gold | dict.fromkeys(("missing_info_to_collect", "next_observations_to_collect"), ["repeat vitals"])
    assert found["schema", "routine"] == {k: v for k, v in gold.items() if k not in ("safety_boundary", "responder_plain_language_script")}
    assert found["source_card_closure", "urgent"]["source_cards"] == ["PED-DEHYD-RED-FLAGS-v1"]
    assert found["source_card_negative_correction", "urgent"]["source_cards"] == [*gold["source_cards"], "WOUND-INFECTION-ESCALATION-v1"]
    assert found["citations_and_pathways", "urgent"]["candidate_protocol_pathways"] == [{"card_id": "NOT-A-CARD", "reason_relevant": "bad citation"}]
    assert found["handoff_note_sbar", "urgent"]["handoff_note_sbar"]["background"] == ""
    assert found["observation_patch_repair", "urgent"]["next_observations_to_collect"][0] == "source card ids"
    assert found["forbidden_clinical_language", "urgent"]["responder_checklist"] == ["Diagnose the condition, prescribe medication, and discharge home."]


@pytest.mark.parametrize("shared", [False, True])
def test_repairs_like_a_loop(spark, shared):
    rng = random.Random(2)
    schedule = [(k, rng.choice("abc")) for k in range(30)]
    eligible = [(s, f"{k}" if shared else f"{k}-{s}", k, f"base{k}") for s in "abc" for k in range(25) if rng.random() < 0.5]
    eligible += eligible[:4]
    taken = [c for _, c, *_ in rng.sample(eligible, 3)]
    gone, want = set(taken), {}
    for position, scope in schedule:
        free = sorted((o, c) for s, c, o, _ in eligible if s == scope and c not in gone)
        want[position] = free[0][1] if free else None
        gone |= {want[position]}
    df = spark.createDataFrame(eligible, "scope string, candidate string, ordinal int, base string")
    found = replay.assign_repairs(spark.createDataFrame(schedule, "position int, scope string"), df, spark.createDataFrame([(c,) for c in taken], "candidate string")).collect()
    assert {r.position: r.candidate for r in found} == want and len(found) == len(want)
    assert None in want.values() if shared else True
