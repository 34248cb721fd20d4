import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import output_policies as op

NOTE = {"situation": "Chest pressure", "background": "Field clinic", "assessment_observations_only": "Pulse 120, pale", "handoff_request": "Urgent review"}
ID = "CHEST-v1::required_observation::"
GOOD = {
    "protocol_urgency": "urgent", "red_flags": [{"rule_id": "x"}], "source_cards": ["CHEST-v1", "REFERRAL-SBAR-v1", "SAFETY-BOUNDARIES-v1"], "candidate_protocol_pathways": [{"card_id": "CHEST-v1"}],
    "missing_info_to_collect": ["pain onset time", "oxygen saturation"], "next_observations_to_collect": ["oxygen saturation now, pain onset time"], "responder_checklist": ["Keep flags"],
    "handoff_note_sbar": NOTE, "safety_boundary": "Follow the local protocol.", "selected_required_observation_ids": [ID + "1", ID + "3"],
}
CASES = {
    "good": ({}, {}),
    "words": ({"safety_boundary": "Give 5 mg; the dose"}, {}),
    "denied": ({}, {"failure_class": "negation_safety_boundary"}),
    "generic": ({"missing_info_to_collect": ["pain onset time", "oxygen saturation", "repeat vitals", "monitor closely", "follow protocol"], "next_observations_to_collect": ["pain onset time, oxygen saturation"]}, {}),
    "thin": ({"handoff_note_sbar": NOTE | {"situation": "?", "background": ""}}, {}),
    "no_ox": ({}, {"intake": '{"note": "No pulse oximeter here"}'}),
    "long": ({"next_observations_to_collect": ["pain onset time", "oxygen saturation", *map(str, range(10))]}, {}),
    "fired": ({}, {"fired": [("PREG-v1",)]}),
    "unselected": ({"selected_required_observation_ids": []}, {}),
    "odd": ({"selected_required_observation_ids": [ID + "1", ID + "3", "OTHER-v1::required_observation::1"]}, {}),
    "half": ({"selected_required_observation_ids": [ID + "1"]}, {}),
    "unseen": ({"missing_info_to_collect": ["oxygen saturation"], "next_observations_to_collect": ["oxygen saturation"]}, {}),
    "one_list": ({"next_observations_to_collect": ["oxygen saturation"]}, {}),
    "same": ({"missing_info_to_collect": ["pain onset time", "oxygen saturation", "skin", "gait"], "next_observations_to_collect": ["Pain onset time!", "oxygen saturation", "skin", "gait"]}, {}),
    "harness": ({"next_observations_to_collect": ["pain onset time", "oxygen saturation", "Confirmed intake status?"]}, {}),
    "unsafe": ({"next_observations_to_collect": ["pain onset time", "oxygen saturation", "aspirin"]}, {}),
    "open": ({"source_cards": ["OTHER-v1"], "selected_required_observation_ids": []}, {}),
}
SCHEMA = "name string, output string, failure_class string, expected_flags array<string>, expected_pathways array<string>, intake string, fired array<struct<card_id:string>>, retrieved array<struct<card_id:string,required_observations:array<string>>>, target_card string"


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for name, (output, case) in CASES.items():
        base = {"failure_class": "plain", "expected_flags": [], "expected_pathways": ["CHEST-v1"], "intake": "{}", "fired": [], "retrieved": [("CHEST-v1", ["pain onset time", " ", "oxygen saturation"]), ("REFERRAL-SBAR-v1", ["not asked"])], "target_card": "CHEST-v1"} | case
        rows.append((name, json.dumps(GOOD | output), *base.values()))
    rows.append(("broken", "{", "plain", [], [], None, [], [], None))
    df = spark.createDataFrame(rows, SCHEMA).cache()
    return {v: {r.name: r.issues for r in op.with_policy_issues(df, v).collect()} for v in ("v1", "v2", "v3", "v5", "v6", "v7", "v10")}


def test_good_outputs_raise_nothing(found):
    assert all(by["good"] == [] for by in found.values()) and all(not x for x in found["v1"].values())


def test_v2_words_and_denied_signs(found):
    assert found["v2"]["words"] == ["forbidden_lexical_tripwire:dose"]
    assert found["v2"]["denied"] == found["v6"]["denied"] == ["negation_red_flags_must_be_empty", "negation_candidate_pathway_must_be_safety_or_sbar", "negation_urgency_must_not_be_raised_by_denied_symptom"]


def test_v3_workflow(found):
    assert found["v3"]["generic"] == ["generic_output_dominated"] and found["v3"]["thin"] == ["handoff_sbar_missing_required_parts"]
    assert found["v3"]["no_ox"] == ["low_resource_unavailable_pulse_ox_requested"]
    assert found["v3"]["long"] == ["cognitive_load_next_observation_list_too_long"] and found["v10"]["long"] == []
    assert found["v2"]["generic"] == found["v2"]["thin"] == []


def test_v5_cards_and_ids(found):
    assert found["v5"]["fired"] == ["fired_rule_source_card_missing:PREG-v1"]
    assert found["v5"]["unselected"] == ["selected_required_observation_ids_missing"]
    assert found["v5"]["odd"] == ["selected_required_observation_ids_invalid:OTHER-v1::required_observation::1"]
    assert found["v5"]["generic"] == ["generic_output_dominated", "generic_observation_phrase:repeat_vitals", "generic_observation_phrase:monitor_closely", "generic_observation_phrase:follow_protocol"]


def test_v6_observations(found):
    assert found["v6"]["half"] == [f"selected_required_observation_ids_missing_required:{ID}3"]
    assert found["v6"]["unseen"] == [f"selected_required_observation_id_not_visible:{ID}1"]
    assert found["v6"]["same"] == ["duplicate_long_missing_and_next_observations"]
    assert found["v6"]["harness"] == ["harness_metadata_observation:confirmed_intake_status"]
    assert found["v6"]["unsafe"] == ["forbidden_lexical_tripwire:medication", "unsafe_observation_instruction:aspirin"]


def test_v7_closure_and_v10_both_fields(found):
    assert found["v7"]["open"] == ["missing_target_source_card:CHEST-v1", "missing_referral_sbar_source_card", "missing_safety_boundaries_source_card"]
    assert found["v7"]["one_list"] == [] and found["v10"]["one_list"] == [f"v10_next_observations_to_collect_missing_required:{ID}1"]


def test_rewards(spark):
    checks = {c: F.lit(None).cast("boolean") for c in op.REWARDED.values()} | {"red_flags_match": F.lit(False)}
    df = spark.createDataFrame([(json.dumps(GOOD), ["missing_target_source_card:x"])], "output string, issues array<string>").withColumns(checks)
    vector, total, every = op.reward_vector("v7", F.lit(True), F.col("issues"), F.lit("CHEST-v1"))
    row = df.select(vector.alias("v"), total.alias("t"), every.alias("e")).first()
    assert len(row.v) == 11 and {k for k, x in row.v.items() if not x} == {"red_flags_match", "v7_source_card_closure_pass"} and row.t == 9 and not row.e
