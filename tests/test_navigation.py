import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import intake, navigation, validation
from sievework.plans.navigation import run_cases

CASE = "case_id string, " + ", ".join(f"{f} string" for f in intake.FIELDS) + ", confirmed boolean"
CARD = "card_id string, title string, applies_to array<string>, required_observations array<string>, red_flags array<string>, escalation_criteria array<string>, local_actions array<string>, forbidden_actions array<string>, safety_boundary string, source_note string"


def case(name, confirmed=True, **fields):
    return (name, *(fields.get(f) for f in intake.FIELDS), confirmed)


def card(name, title, observations, flags):
    return (name, title, ["field use"], observations, flags, [], [], [], "own boundary", "own note")


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        card("CHEST-PAIN-ESCALATION-v1", "Chest pain", ["pain onset time", "pulse rate"], ["chest pressure"]),
        card("FEVER-RED-FLAGS-v1", "Fever", ["repeat temperature", "neck stiffness"], ["stiff neck", "fever"]),
        card("PED-DEHYD-RED-FLAGS-v1", "Child dehydration", ["urine output", "mouth moisture"], ["no urine"]),
        card("SAFETY-BOUNDARIES-v1", "Boundaries", [], []),
    ]
    return spark.createDataFrame(rows, CARD)


CASES = [
    case("chest", symptoms="crushing chest pressure since noon", vitals="pulse 120"),
    case("denied", symptoms="denies chest pain or sweating"),
    case("denied_but", symptoms="denies sweating but now chest pain"),
    case("child", patient_age="8 months", symptoms="no urine since morning"),
    case("sleepy_child", patient_age="7", symptoms="lethargic and pale"),
    case("adult_dry", patient_age="40 years", symptoms="no urine since morning"),
    case("old_months", patient_age="240 months", symptoms="no urine"),
    case("fever_denied", symptoms="stiff neck, no fever reported"),
    case("fever_measured", symptoms="stiff neck, no fever reported", vitals="temp 39.2 c"),
    case("pregnant", pregnancy_status="pregnant", symptoms="severe headache"),
    case("not_pregnant", pregnancy_status="not_pregnant", symptoms="severe headache, not pregnant"),
    case("burnout", symptoms="burnout with pus on a tooth"),
    case("quiet", symptoms="mild itch"),
    case("blank"),
    case("open", confirmed=False, symptoms="chest pain"),
]


def test_rules_by_situation(spark):
    rows = intake.evaluate(spark.createDataFrame(CASES, CASE), strict=False).collect()
    fired = {r.case_id: [(x.rule_id, x.severity, x.evidence) for x in r.fired] for r in rows}
    assert fired["chest"] == [("red_flag_chest_pain", "emergency", "chest pressure")]
    assert fired["denied"] == [] and fired["denied_but"][0][0] == "red_flag_chest_pain"
    assert fired["child"] == [("PED-DEHYD-001", "urgent", "no urine")]
    assert fired["sleepy_child"] == [("PED-DEHYD-001", "emergency", "lethargic")]
    assert fired["adult_dry"] == [] and fired["old_months"] == []
    assert fired["fever_denied"] == [] and fired["fever_measured"] == [("FEVER-001", "urgent", "stiff neck")]
    assert fired["pregnant"] == [("PREG-001", "emergency", "severe headache")] and fired["not_pregnant"] == []
    assert fired["burnout"] == [("WOUND-001", "urgent", "pus")]
    assert fired["open"] == [] and fired["quiet"] == []
    floors = {r.case_id: r.floor for r in rows}
    assert floors["chest"] == "emergency" and floors["child"] == "urgent" and floors["quiet"] == "routine"


def test_unconfirmed_record_is_an_error_when_strict(spark):
    with pytest.raises(Exception, match="confirmed"):
        intake.evaluate(spark.createDataFrame([case("open", confirmed=False)], CASE)).collect()


def test_ledger(spark):
    rows = intake.fact_ledger(spark.createDataFrame([case("a", symptoms="no cough, denies pain", vitals="unknown"), case("b", confirmed=False)], CASE), "case_id").collect()
    found = {(r.case_id, r.bucket, r.field, r.value) for r in rows}
    assert found == {
        ("a", "present", "symptoms", "no cough, denies pain"),
        ("a", "absent_or_denied", "symptoms", "no cough"),
        ("a", "absent_or_denied", "symptoms", "denies pain"),
        ("a", "unclear", "vitals", "unknown"),
        ("b", "unclear", "confirmed", "intake is not confirmed"),
    }


def test_deterministic_outputs_pass_their_validation(spark, cards):
    rows = run_cases(spark.createDataFrame([c for c in CASES if c[-1]], CASE), cards).collect()
    assert len(rows) == len([c for c in CASES if c[-1]])
    bad = {r.case_id: r.failures for r in rows if not r.passed and r.case_id in ("chest", "child", "fever_measured", "sleepy_child")}
    assert bad == {}
    chest = json.loads(next(r.output for r in rows if r.case_id == "chest"))
    assert chest["protocol_urgency"] == "emergency" and chest["source_cards"][0] == "CHEST-PAIN-ESCALATION-v1"
    assert "pain onset time" in chest["missing_info_to_collect"]


def good_output(**changes):
    made = {
        "protocol_urgency": "emergency", "red_flags": [], "intake_facts": [], "candidate_protocol_pathways": [{"card_id": "CHEST-PAIN-ESCALATION-v1", "reason_relevant": "x"}],
        "missing_info_to_collect": ["pain onset time"], "next_observations_to_collect": ["pulse rate"], "conflicts_or_uncertainties": [], "responder_checklist": ["Do not diagnose or prescribe."],
        "do_not_do": [], "source_cards": ["CHEST-PAIN-ESCALATION-v1"], "responder_plain_language_script": "Stay with me.", "safety_boundary": "Protocols only.",
        "handoff_note_sbar": {"situation": "chest pressure", "background": "chest pain rule", "assessment_observations_only": "chest pressure since noon", "handoff_request": "review"},
    }
    return json.dumps(made | changes)


OUTPUTS = {
    "good": good_output(),
    "not_object": "[1]",
    "broken": "{",
    "low": good_output(protocol_urgency="monitor"),
    "odd": good_output(protocol_urgency="high"),
    "wrong_types": good_output(red_flags="none", safety_boundary=["x"]),
    "unknown_card": good_output(source_cards=["CHEST-PAIN-ESCALATION-v1", "NO-SUCH-v1"]),
    "uncited": good_output(source_cards=["FEVER-RED-FLAGS-v1"], candidate_protocol_pathways=[]),
    "uncovered": good_output(missing_info_to_collect=[], next_observations_to_collect=[]),
    "empty_slot": good_output(handoff_note_sbar={"situation": "chest pressure", "background": "", "assessment_observations_only": "x", "handoff_request": "r"}),
    "ungrounded": good_output(handoff_note_sbar={"situation": "broken ankle", "background": "chest rule", "assessment_observations_only": "chest pressure with seizure", "handoff_request": "r"}),
    "unsafe": good_output(responder_plain_language_script="We diagnose this and give 5 mg now."),
    "negated": good_output(responder_plain_language_script="Never diagnose. Do not prescribe, diagnose or discharge home."),
}


def test_validation_by_situation(spark, cards):
    base = run_cases(spark.createDataFrame([CASES[0]], CASE), cards).drop("output", "failures", "passed", "route", "trace_hash")
    outputs = spark.createDataFrame(list(OUTPUTS.items()), "name string, output string")
    failures = {r.name: r.failures for r in validation.validate(base.crossJoin(outputs)).collect()}
    assert failures["good"] == [] and failures["negated"] == []
    assert failures["not_object"] == failures["broken"] == ["navigator output is not an object"]
    assert failures["low"] == ["protocol_urgency monitor is below deterministic floor emergency"]
    assert failures["odd"] == ["protocol_urgency is missing or invalid"]
    assert failures["wrong_types"] == ["red_flags must be a list", "safety_boundary must be a string"]
    assert failures["unknown_card"][0] == "unknown source_cards: NO-SUCH-v1"
    assert "fired rule card CHEST-PAIN-ESCALATION-v1 is not cited in source_cards" in failures["uncited"]
    assert failures["uncovered"] == ["missing_info_to_collect does not reference required observations for CHEST-PAIN-ESCALATION-v1: pain onset time, pulse rate"]
    assert failures["empty_slot"] == ["handoff_note_sbar is missing: background"]
    assert failures["ungrounded"] == ["handoff_note_sbar situation is not grounded in confirmed intake or rules", "handoff_note_sbar assessment_observations_only has unsupported high-risk handoff facts: seizure"]
    assert failures["unsafe"] == ["forbidden clinical language: diagnose", "forbidden clinical language: give 5 mg"]
    scopes = validation.repair_scopes(validation.validate(base.crossJoin(outputs)), "name").collect()
    assert {(r.name, r.scope) for r in scopes if r.name in ("low", "unsafe", "uncovered", "wrong_types", "empty_slot", "unknown_card")} == {
        ("low", "protocol_urgency"), ("unsafe", "forbidden_clinical_language"), ("uncovered", "missing_observations"), ("wrong_types", "schema"), ("empty_slot", "handoff_note_sbar"), ("unknown_card", "citations_and_pathways"),
    }


def test_model_output_or_fallback(spark, cards):
    cases = spark.createDataFrame([(*CASES[0], good_output()), (*case("again", symptoms="chest pressure"), "{"), (*case("third", symptoms="chest pressure"), None)], CASE + ", reply string")
    rows = {r.case_id: r for r in run_cases(cases, cards, model_output="reply").collect()}
    assert rows["chest"].route == "live_model_generated" and rows["chest"].passed
    assert rows["again"].route == "validation_fallback" and rows["third"].route == "canned_backend"


def test_targets_scaffold_and_note(spark, cards):
    targets = navigation.observation_targets(cards).collect()
    assert {t.id for t in targets} >= {"FEVER-RED-FLAGS-v1::required_observation::2"}
    base = run_cases(spark.createDataFrame([CASES[0]], CASE), cards)
    rows = base.select("*", F.lit("monitor").alias("urgency"), F.array(F.lit("BAD-v1")).alias("source_cards"), F.array().cast("array<string>").alias("pathways"), F.array(F.lit("pulse rate")).alias("observations"))
    r = navigation.scaffold(rows).first()
    assert r.urgency == "emergency" and r.source_cards == ["CHEST-PAIN-ESCALATION-v1"] == r.pathways
    assert r.observations == ["pulse rate", "pain onset time"] and r.patched == ["protocol_urgency", "source_cards", "candidate_protocol_pathways", "missing_info_to_collect"]
    note = navigation.handoff_note(F.col("floor"), F.array(F.lit("C1")))
    text = base.select(navigation.render_note(note, F.array(F.lit("C1")), F.lit("own boundary")).alias("t"), navigation.handoff_readiness(note, F.array(F.lit("C1")), F.array(F.lit("R1")), F.lit(0)).alias("h")).first()
    assert text.t.startswith("S: crushing chest pressure since noon\nB: ") and text.t.endswith("Safety boundary: own boundary")
    assert text.h.ready
