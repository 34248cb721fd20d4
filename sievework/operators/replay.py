"""Replay corpora: audits of rows with their reasons and scores, and repair rows drawn from base rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.sets import compact_issues
from sievework.functions.text import squeeze
from sievework.operators.output_policies import HANDOFF, SAFETY, SAFETY_TERMS, SELECTED, holds
from sievework.operators.recovery import fields_of, object_of
from sievework.sources.cuts import cut

#: Cues of the harness, phrases and fragments that no observation may hold; where targets must be selected; scores of categories.
HARNESS_PHRASES = (
    "confirmed intake status", "deterministic rule results", "manual correction status for audio-derived fields", "navigator validation result",
    "retrieved protocol card ids", "source card ids", "source protocol card ids",
)
GENERIC_PHRASES = ("assess patient", "collect more information", "follow up", "monitor closely", "repeat vitals")
UNSAFE_FRAGMENTS = ("clear for discharge", "diagnose", "discharge", "dose", "prescribe", "send home", "start medication")
OBSERVATION_CATEGORIES = ("focused_repair:missing_observations", "missing_observation_prioritization", "required_observation_id_selection")
PRIORITY = {
    "focused_repair:handoff_note_sbar": 100, "focused_repair:citations_and_pathways": 95, "focused_repair:protocol_urgency": 90, "focused_repair:schema": 85,
    "source_card_invariant": 80, "sbar_observation_ownership": 78, "general_regression": 76, "noisy_field_audio_style": 74, "radio_handoff": 72,
    "sbar_handoff_usefulness": 70, "source_card_discipline": 68, "low_resource_constraints": 66, "rural_clinic_intake": 64, "disaster_triage": 62,
}
#: Cards about patients, as against those of safety and hand-off.
CLINICAL_CARDS = (
    "AMS-RED-FLAGS-v1", "CHEST-PAIN-ESCALATION-v1", "PED-DEHYD-RED-FLAGS-v1", "FEVER-RED-FLAGS-v1", "PREG-DANGER-SIGNS-v1",
    "RESP-DISTRESS-RED-FLAGS-v1", "STROKE-SIGNS-v1", "WOUND-INFECTION-ESCALATION-v1",
)
OTHER_PRIORITY = 20
CLEAN, SELECTS, REPAIRS, PATCHED = 25, 10, 15, 20
CLOSED, FEW_CARDS, FULL_ROW = 15, 8, 5


def texts(value: Column, path: str) -> Column:
    """The texts of a list in a variant, trimmed, blank ones left out; anything else is empty."""
    found = F.coalesce(F.try_variant_get(value, path, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def parsed_rows(df: DataFrame, row: str = "row") -> DataFrame:
    """df with _row and _out (variants; _out is null unless the last message holds a JSON object), category and task_type."""
    v = F.try_parse_json(row)
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    content = F.try_variant_get(F.element_at(messages, -1), "$.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    out = F.try_parse_json(text)
    filled = lambda path: F.nullif(F.try_variant_get(F.col("_row"), path, "string"), F.lit(""))
    rows = df.withColumns({"_row": v, "_text": F.when((F.size(messages) > 0) & F.schema_of_variant(out).startswith("OBJECT"), text)})
    rows = rows.withColumn("_out", F.try_parse_json("_text"))
    kind = F.when(F.try_variant_get("_out", "$.protocol_urgency", "variant").isNotNull(), "navigator_full").otherwise("focused_repair")
    return rows.withColumns({"category": F.coalesce(filled("$.category"), filled("$.metadata.category"), filled("$.metadata.failure_class"), F.lit("missing")), "task_type": F.coalesce(filled("$.metadata.task_type"), kind)})


def replay_audit(df: DataFrame, row: str = "row", closure: bool = False) -> DataFrame:
    """df with category, task_type, accepted, reasons and score. With closure also the rules for cited cards: those of a later
    policy, which adds to the score of the former. A row without a JSON object as its answer scores 0."""
    rows = parsed_rows(df, row)
    r, out = F.col("_row"), F.col("_out")
    flag = lambda path: F.try_variant_get(r, f"$.metadata.{path}", "boolean")
    low = F.lower("_text")
    missing, following = texts(out, "$.missing_info_to_collect"), texts(out, "$.next_observations_to_collect")
    items = F.transform(F.concat(missing, following), squeeze)
    selected, must = texts(out, f"$.{SELECTED}"), texts(r, f"$.metadata.must_include_{SELECTED}")
    named = lambda prefix, phrases, held: [F.when(F.exists(items, held(squeeze(F.lit(p)))), F.lit(f"{prefix}:{p.replace(' ', '_')}")) for p in phrases]
    within, same = (lambda p: lambda x: F.contains(x, p)), (lambda p: lambda x: x == p)
    full = F.col("task_type") == "navigator_full"
    when = lambda condition, name: F.when(condition, F.lit(name))
    found = compact_issues(
        when(~flag("validator_passed"), "validator_failed"),
        when(~flag("validation_result.passed"), "validation_result_failed"),
        when(~flag("expected_label_score.all_expected_labels_passed"), "expected_labels_failed"),
        when(~flag("expected_label_score.forbidden_behavior_absent"), "forbidden_behavior_present"),
        when(F.contains(low, F.lit("teacher")), "teacher_artifact"),
        when(low.rlike("</?think"), "visible_reasoning_tag"),
        when((F.size(missing) > 3) & (missing == following), "duplicate_long_missing_and_next_observations"),
        *named("harness_metadata_observation", HARNESS_PHRASES, within),
        *named("generic_observation_phrase", GENERIC_PHRASES, same),
        *named("unsafe_observation_fragment", UNSAFE_FRAGMENTS, within),
        when(full & F.col("category").isin(*OBSERVATION_CATEGORIES) & (F.size(selected) == 0), f"observation_focused_row_missing_{SELECTED}"),
        when(F.size(texts(r, f"$.metadata.invalid_{SELECTED}")) > 0, f"invalid_{SELECTED}"),
        when((F.size(selected) > 0) & (F.size(F.array_except(must, selected)) > 0), f"{SELECTED}_missing_required"),
    )
    priority = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    patched = F.arrays_overlap(texts(r, "$.metadata.deterministic_scaffold_patched_fields"), F.array(F.lit("missing_info_to_collect"), F.lit("next_observations_to_collect")))
    plus = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    rows = rows.withColumn("reasons", found)
    clean = F.size("reasons") == 0
    score = F.coalesce(F.try_element_at(priority, F.col("category")), F.lit(OTHER_PRIORITY)) - plus(patched, PATCHED) + plus(F.size(selected) > 0, SELECTS) + plus(F.col("task_type") == "focused_repair", REPAIRS) + plus(clean, CLEAN)
    rows = rows.withColumn("score", score)
    if closure:
        cards = texts(out, "$.source_cards")
        rows = rows.withColumn("reasons", F.array_distinct(F.concat("reasons", F.when(full, closure_issues(r, out, cards)).otherwise(F.array().cast("array<string>")))))
        both = F.array_contains(cards, SAFETY) & F.array_contains(cards, HANDOFF)
        rows = rows.withColumn("score", F.col("score") + plus(both, CLOSED) + plus(F.size(cards).between(3, 5), FEW_CARDS) + plus(full, FULL_ROW) + plus(clean, CLEAN))
    readable = F.col("_out").isNotNull()
    rows = rows.withColumns({"reasons": F.when(readable, F.col("reasons")).otherwise(F.array(F.lit("assistant_content_not_json"))), "score": F.when(readable, F.col("score")).otherwise(F.lit(0)).cast("int")})
    return rows.withColumn("accepted", F.size("reasons") == 0).drop("_row", "_out", "_text")


def closure_issues(row: Column, out: Column, cards: Column) -> Column:
    """Cards that the sources must close over: the target's, the hand-off card with a note, the safety card with safety language."""
    clinical = F.filter(F.concat(texts(row, "$.metadata.must_include_source_cards"), texts(out, "$.source_cards")), lambda c: c.isin(*CLINICAL_CARDS))
    target = F.get(clinical, F.lit(0))
    lacks = lambda c: ~F.array_contains(cards, c)
    note = F.to_json(F.try_variant_get(out, "$.handoff_note_sbar", "variant"))
    spoken = F.lower(F.concat_ws(" ", *(F.to_json(F.try_variant_get(out, f"$.{k}", "variant")) for k in ("safety_boundary", "do_not_do", "responder_plain_language_script"))))
    return compact_issues(
        F.when(target.isNotNull() & lacks(target), F.concat(F.lit("missing_target_source_card:"), target)),
        F.when(F.coalesce(note, F.lit("null")).rlike(r'^(?!(?:\{\}|\[\]|""|false|null|0)$).+') & lacks(F.lit(HANDOFF)), F.lit("missing_referral_sbar_source_card")),
        F.when(holds(spoken, SAFETY_TERMS) & lacks(F.lit(SAFETY)), F.lit("missing_safety_boundaries_source_card")),
    )


#: What a repair scope puts into an output, for rows that repair it again, as JSON texts of fields.
BROKEN = {
    "missing_observations": {"missing_info_to_collect": '["repeat vitals"]', "next_observations_to_collect": '["repeat vitals"]'},
    "citations_and_pathways": {"source_cards": "[]", "candidate_protocol_pathways": '[{"card_id":"NOT-A-CARD","reason_relevant":"bad citation"}]'},
    "handoff_note_sbar": {"handoff_note_sbar": '{"situation":"unsupported rash oxygen pregnancy finding","background":"","assessment_observations_only":"","handoff_request":""}'},
    "forbidden_clinical_language": {"responder_checklist": '["Diagnose the condition, prescribe medication, and discharge home."]'},
    "protocol_urgency": {"protocol_urgency": '"routine"'},
    "observation_patch_repair": {k: '["source card ids","deterministic rule results","navigator validation result"]' for k in ("missing_info_to_collect", "next_observations_to_collect")},
}
REMOVED = {"schema": ("safety_boundary", "responder_plain_language_script")}
DISTRACTORS = ("PED-DEHYD-RED-FLAGS-v1", "WOUND-INFECTION-ESCALATION-v1", "FEVER-RED-FLAGS-v1")
SCOPES = (*BROKEN, *REMOVED, "source_card_closure", "source_card_negative_correction")


def corrupted(output: Column, scope: Column, floor: Column) -> Column:
    """A JSON output with what its scope breaks, fields in name order; null for an unknown scope, or if the scope cannot break it
    (an urgency that may be routine)."""
    fields = fields_of(output)
    cards = texts(F.try_parse_json(output), "$.source_cards")
    some = lambda names: F.array(*map(F.lit, names))
    left = F.array_except(some(DISTRACTORS), cards)
    put = F.create_map().cast("map<string,string>")
    for name, values in BROKEN.items():
        put = F.when(scope == name, F.create_map(*(F.lit(x) for pair in values.items() for x in pair))).otherwise(put)
    put = F.when(scope == "source_card_closure", F.create_map(F.lit("source_cards"), F.to_json(F.filter(cards, lambda c: ~c.isin(SAFETY, HANDOFF))))).otherwise(put)
    put = F.when(scope == "source_card_negative_correction", F.create_map(F.lit("source_cards"), F.to_json(F.concat(cards, F.slice(left, 1, 1))))).otherwise(put)
    gone = F.when(scope == "schema", some(REMOVED["schema"])).otherwise(F.array().cast("array<string>"))

    def made(new: Column, without: Column) -> Column:
        kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(new, k) & ~F.array_contains(without, k))
        every = F.map_concat(kept, new)
        return object_of(F.transform(F.array_sort(F.map_keys(every)), lambda k: F.struct(k.alias("field"), F.try_element_at(every, k).alias("value"))))

    possible = scope.isin(*SCOPES) & ~((scope == "protocol_urgency") & (floor == "routine"))
    return F.when(possible, made(put, gone))


def assign_repairs(schedule: DataFrame, eligible: DataFrame, taken: DataFrame | None = None, scope: str = "scope", position: str = "position", candidate: str = "candidate", ordinal: str = "ordinal") -> DataFrame:
    """Each turn's candidate: a loop over the turns, each taking the first candidate of its scope that is not taken yet.

    schedule: position and scope, one row a turn; eligible: scope, candidate (the id of the row that would be made), ordinal
    (its place among the base rows), anything else; taken: candidates that exist already. A candidate may serve several
    scopes, and is then gone for all. Turns left without one have null.

    Rounds: every scope's open turns take its free candidates in order, one each; where scopes meet in a candidate the
    earliest turn keeps it, and what that turn's scope took before it stands. The first turn that lost its candidate, and all
    later turns, go on; so each round settles at least the turns before the first clash, and none if there is no clash.
    """
    free = eligible if taken is None else eligible.join(taken.select(candidate).distinct(), candidate, "left_anti")
    free = cut(free.groupBy(scope, candidate).agg(F.min(ordinal).alias(ordinal)), "repair-candidates")
    open_turns, settled = cut(schedule.select(position, scope), "repair-turns"), None
    while True:
        turns = open_turns.withColumn("_k", F.row_number().over(Window.partitionBy(scope).orderBy(position)))
        ranked = free.withColumn("_k", F.row_number().over(Window.partitionBy(scope).orderBy(ordinal, candidate)))
        proposed = cut(turns.join(ranked, [scope, "_k"], "left").select(position, scope, candidate, ordinal), "repair-proposals")
        holders = proposed.where(F.col(candidate).isNotNull()).groupBy(candidate).agg(F.min(position).alias("_holder"), F.count("*").alias("_n"))
        lost = proposed.join(holders.where("_n > 1"), candidate).where(F.col(position) > F.col("_holder")).agg(F.min(position)).first()[0]
        # Up to the first turn that lost, every turn has what the loop gives it.
        good = proposed if lost is None else proposed.where(F.col(position) < lost)
        settled = good if settled is None else settled.unionByName(good)
        if lost is None:
            return settled
        free = cut(free.join(good.where(F.col(candidate).isNotNull()).select(candidate), candidate, "left_anti"), "repair-candidates")
        open_turns = cut(open_turns.where(F.col(position) >= lost), "repair-turns")
