"""The policies that an accepted output has to keep, by dataset version, as one array of issues.

A version carries the policies that policies.policies_of names; each adds its issues to those before, and equal ones count
once. All are Columns over the parsed output, so a corpus is checked in one scan. Needed columns: output (JSON),
failure_class, expected_flags and expected_pathways (arrays), intake (JSON), fired (see screening), retrieved (array of struct
of card_id and required_observations), target_card.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.sets import compact_issues
from sievework.functions.text import normalize, words
from sievework.operators.labels import listed, pathway_cards
from sievework.operators.policies import policies_of, rewards, same_long_lists, thin_note
from sievework.operators.validation import EXEMPT_CARDS, SLOTS

SAFETY, HANDOFF = EXEMPT_CARDS

#: Words that trip a label, phrases that say nothing, cues that belong to the harness.
LEXICAL = {
    "diagnose": r"\bdiagnos(?:e|is|ed)\b",
    "prescribe": r"\bprescrib(?:e|ing|ed)\b",
    "dose": r"\b(?:dose|dosing)\b|\bgive \d+(?:\.\d+)?\s*(?:mg|mcg|ml)\b",
    "administer": r"\b(?:administer|inject|dispense)\b",
    "medication": r"\b(?:aspirin|antibiotic|opioid|insulin|medication|medications|drug)\b",
    "discharge": r"\b(?:discharge(?: home)?|send (?:them|the patient|the person|him|her)?\s*home)\b",
}
GENERIC = (r"\brepeat\s+vitals?\b", r"\bmonitor\s+closely\b", r"\bfollow\s+protocol\b", r"\bassess\s+(?:the\s+)?patient\b", r"\bcollect\s+more\s+information\b", r"\bcontinue\s+to\s+observe\b")
GENERIC_OBSERVATIONS = (*GENERIC, r"\bask\s+(?:anything|everything)\s+else\b", r"\bkeep\s+monitoring\b", r"\bcheck\s+vitals?\b")
HARNESS_CUES = (
    "source card ids", "source protocol card ids", "retrieved protocol card ids", "deterministic rule results", "navigator validation result",
    "confirmed intake status", "manual correction status for audio-derived fields",
)
NOTE_CLASSES = ("radio_handoff", "sbar_handoff_usefulness", "workflow_repair_seed")
#: What tells that a device is not there, what asks for it all the same, and what owns up to the lack.
SUPPLIES = {
    "pulse_ox": (("no pulse oximeter", "no pulse ox", "oxygen saturation unavailable"), ("pulse ox", "pulse oximeter", "oxygen saturation", "spo2", "repeat vitals"), ("pulse ox", "pulse oximeter", "oxygen saturation", "spo2")),
    "bp": (("no bp cuff", "blood pressure not available", "no blood pressure cuff"), ("blood pressure", "bp cuff", "repeat vitals"), ("blood pressure", "bp cuff", "bp")),
}
WITHOUT = {"pulse_ox": "oxygen saturation unavailable; observe work of breathing and speech", "bp": "blood pressure unavailable; note perfusion and mental status"}
SAFETY_TERMS = ("local protocol", "do not diagnose", "do not provide clinical orders", "do not provide treatment instructions", "safety boundary")
SELECTED = "selected_required_observation_ids"
MOST_NEXT, MOST_SELECTED, THIN = 10, 8, 6


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(operator.or_, (F.contains(text, F.lit(p)) for p in phrases))


def says(text: Column, patterns) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def counter_key(text: Column) -> Column:
    made = F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_.:-]+", "_"), F.lit("_")), 1, 120)
    return F.when(made == "", F.lit("unknown")).otherwise(made)


def each(items: Column, wrong, issue: str) -> Column:
    """An issue for every item that is wrong, named by the item."""
    return F.transform(F.filter(items, wrong), lambda x: F.concat(F.lit(f"{issue}:"), counter_key(x)))


def only(*found: Column) -> Column:
    return compact_issues(*found)


def required_targets(retrieved: Column, cited: Column) -> Column:
    """Targets (id, card, text) of the cited retrieved cards that are not exempt; a blank observation keeps its number."""
    of = lambda c: F.filter(F.transform(c["required_observations"], lambda t, i: F.struct(F.concat(c["card_id"], F.lit("::required_observation::"), (i + 1).cast("string")).alias("id"), c["card_id"].alias("card"), F.trim(t).alias("text"))), lambda t: t["text"] != "")
    return F.flatten(F.transform(F.filter(retrieved, lambda c: F.array_contains(cited, c["card_id"]) & ~c["card_id"].isin(*EXEMPT_CARDS)), of))


def required_ids(active: tuple[str, ...], targets: Column, cited: Column, target: Column, failure_class: Column) -> Column:
    """The ids that a label must select: all; with the source-card policy, unless the multi-rule one holds too, those of the
    target, of the first cited card for coupled notes, or the first few."""
    ids = lambda ts: F.array_distinct(F.transform(ts, lambda t: t["id"]))
    every = ids(targets)
    if "v8" in active or "v7" not in active:
        return every
    own = ids(F.filter(targets, lambda t: t["card"] == target))
    by_card = F.filter(F.transform(cited, lambda c: ids(F.filter(targets, lambda t: t["card"] == c))), lambda x: F.size(x) > 0)
    first = F.get(by_card, F.lit(0))
    return F.when(F.size(own) > 0, own).when((failure_class == "sbar_source_coupling") & first.isNotNull(), first).otherwise(F.slice(every, 1, MOST_SELECTED))


def resource_aware(text: Column, intake: Column) -> Column:
    """A target's text as it stands where the device for it is not there."""
    low, lacks = F.lower(text), lambda device: holds(intake, SUPPLIES[device][0])
    saturation = F.when(lacks("pulse_ox") & holds(low, SUPPLIES["pulse_ox"][2]), F.lit(WITHOUT["pulse_ox"]))
    pressure = F.when(lacks("bp") & (F.contains(low, F.lit("blood pressure")) | (low == "bp")), F.lit(WITHOUT["bp"]))
    return F.coalesce(saturation, pressure, text)


def seen(text: Column, said: Column, intake: Column) -> Column:
    """Whether an observation target shows in a text: all its words, its phrase, or the phrase for a missing device."""
    flat = normalize(said)
    return (F.size(F.array_except(words(text), words(said))) == 0) | F.contains(flat, normalize(text)) | F.contains(flat, normalize(resource_aware(text, intake)))


def with_policy_issues(df: DataFrame, version: str, into: str = "issues") -> DataFrame:
    """df with the issues of every policy that the version carries, in their order, each once."""
    active = policies_of(version)
    raw, v = F.lower("output"), F.try_parse_json("output")
    rows = df.withColumn("_p", F.struct(v.alias("v"), raw.alias("text"), F.lower(F.coalesce("intake", F.lit("{}"))).alias("intake")))
    p = F.col("_p")
    out, text, intake = p["v"], p["text"], p["intake"]
    case = F.col("failure_class")
    cited, flags = listed(out, "source_cards"), F.try_variant_get(out, "$.red_flags", "array<variant>")
    lacking, following, checklist = (listed(out, k) for k in ("missing_info_to_collect", "next_observations_to_collect", "responder_checklist"))
    note = F.struct(*(F.try_variant_get(out, f"$.handoff_note_sbar.{s}", "string").alias(s) for s in SLOTS))
    thin = F.size(F.filter(F.array(*(note[s] for s in SLOTS)), lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) < THIN))
    observed = F.concat(lacking, following)
    none = F.array().cast("array<string>")
    parts = []
    later = bool({"v3", "v5", "v6"} & set(active))
    if later or "v2" in active:
        classes = ("negation_safety_boundary", "escalation_precision") if later else ("negation_safety_boundary",)
        denied = case.isin(*classes) & (F.size("expected_flags") == 0)
        paths, wanted = pathway_cards(out), F.array_distinct("expected_pathways")
        good = (F.size(paths) > 0) & (F.size(F.array_except(wanted, F.array(F.lit(SAFETY), F.lit(HANDOFF)))) == 0) & (F.size(F.array_except(wanted, paths)) == 0)
        urgency = F.coalesce(F.try_variant_get(out, "$.protocol_urgency", "string"), F.lit(""))
        parts.append(only(*(F.when(says(text, (pattern,)), F.lit(f"forbidden_lexical_tripwire:{name}")) for name, pattern in LEXICAL.items())))
        parts.append(
            only(
                F.when(denied & (F.size(flags) > 0), F.lit("negation_red_flags_must_be_empty")),
                F.when(denied & ~good, F.lit("negation_candidate_pathway_must_be_safety_or_sbar")),
                F.when(denied & ~urgency.isin("routine", "monitor"), F.lit("negation_urgency_must_not_be_raised_by_denied_symptom")),
            )
        )
    if later:
        items = F.concat(observed, checklist)
        dull = F.size(F.filter(items, lambda x: says(x, GENERIC)))
        wants = {d: holds(intake, told) & holds(text, asked) & ~(F.contains(text, F.lit("unavailable")) & holds(text, owned)) for d, (told, asked, owned) in SUPPLIES.items()}
        parts.append(
            only(
                F.when((F.size(items) > 0) & (dull >= F.greatest(F.lit(3), F.floor(F.size(items) / 2).cast("int"))), F.lit("generic_output_dominated")),
                F.when((thin > 0) & (case.isin(*NOTE_CLASSES) | (thin >= 2)), F.lit("handoff_sbar_missing_required_parts")),
                *(F.when(wants[d], F.lit(f"low_resource_unavailable_{d}_requested")) for d in SUPPLIES),
                F.when(F.size(following) > MOST_NEXT, F.lit("cognitive_load_next_observation_list_too_long")) if "v10" not in active else F.lit(None).cast("string"),
            )
        )
    targets = required_targets(F.col("retrieved"), cited)
    needed = required_ids(active, targets, cited, F.col("target_card"), case)
    chosen = listed(out, SELECTED)
    card_of = lambda ids: F.array_distinct(F.transform(F.filter(ids, lambda x: F.contains(x, F.lit("::required_observation::"))), lambda x: F.substring_index(x, "::required_observation::", 1)))
    joined = lambda name, ids: F.when(F.size(ids) > 0, F.concat(F.lit(f"{name}:"), F.array_join(F.array_sort(F.array_distinct(ids)), ",")))
    if {"v5", "v6"} & set(active):
        fired = F.filter(F.transform("fired", lambda r: F.trim(r["card_id"])), lambda c: (c != "") & ~F.array_contains(cited, c))
        odd_cards = F.when(F.size(chosen) > 0, F.array_sort(F.array_except(card_of(needed), card_of(chosen)))).otherwise(none)
        asks_note = (F.col("target_card") == HANDOFF) | F.array_contains(cited, HANDOFF) | case.isin("sbar_observation_ownership", *NOTE_CLASSES)
        parts += [
            F.transform(fired, lambda c: F.concat(F.lit("fired_rule_source_card_missing:"), c)),
            only(
                F.when((F.size(needed) > 0) & (F.size(chosen) == 0), F.lit(f"{SELECTED}_missing")),
                joined(f"{SELECTED}_invalid", F.array_except(chosen, needed)),
            ),
            F.transform(odd_cards, lambda c: F.concat(F.lit(f"{SELECTED}_missing_for_card:"), c)),
            each(observed, lambda x: says(x, GENERIC_OBSERVATIONS), "generic_observation_phrase"),
            only(F.when(asks_note & thin_note(note, THIN), F.lit("handoff_sbar_missing_required_parts"))),
        ]
    if "v6" in active:
        shown = F.array_join(observed, "\n")
        every = required_targets(F.col("retrieved"), F.transform("retrieved", lambda c: c["card_id"]))
        exempt = F.flatten(F.transform(F.filter("retrieved", lambda c: c["card_id"].isin(*EXEMPT_CARDS)), lambda c: F.transform(c["required_observations"], lambda t, i: F.concat(c["card_id"], F.lit("::required_observation::"), (i + 1).cast("string")))))
        known = F.concat(F.transform(every, lambda t: t["id"]), F.coalesce(exempt, none))
        unseen = F.filter(every, lambda t: F.array_contains(chosen, t["id"]) & ~seen(t["text"], shown, intake))
        parts += [
            only(F.when(same_long_lists(lacking, following), F.lit("duplicate_long_missing_and_next_observations"))),
            each(observed, lambda x: holds(normalize(x), tuple(c.replace("-", " ") for c in HARNESS_CUES)), "harness_metadata_observation"),
            each(observed, lambda x: says(x, LEXICAL.values()), "unsafe_observation_instruction"),
            only(joined(f"{SELECTED}_invalid", F.array_except(chosen, known)), joined(f"{SELECTED}_missing_required", F.array_except(needed, chosen))),
            F.transform(unseen, lambda t: F.concat(F.lit("selected_required_observation_id_not_visible:"), t["id"])),
        ]
    if "v10" in active:
        for name, said in (("missing_info_to_collect", lacking), ("next_observations_to_collect", following)):
            parts.append(dual_field(targets, needed, name, F.array_join(said, "\n"), intake))
    if "v7" in active:
        spoken = F.lower(F.concat_ws(" ", *(F.get_json_object("output", f"$.{k}") for k in ("safety_boundary", "do_not_do", "responder_plain_language_script"))))
        has_note = F.coalesce(F.get_json_object("output", "$.handoff_note_sbar"), F.lit("")).rlike(r"^(?!\{\s*\}$|\[\s*\]$|false$|0$).+")
        target, lacks = F.nullif(F.col("target_card"), F.lit("")), lambda c: ~F.array_contains(cited, c)
        parts.append(
            only(
                F.when(target.isNotNull() & lacks(target), F.concat(F.lit("missing_target_source_card:"), target)),
                F.when(has_note & lacks(HANDOFF), F.lit("missing_referral_sbar_source_card")),
                F.when(holds(spoken, SAFETY_TERMS) & lacks(SAFETY), F.lit("missing_safety_boundaries_source_card")),
            )
        )
    found = F.array_distinct(F.concat(*parts)) if parts else none
    return rows.withColumn(into, F.coalesce(found, none)).drop("_p")


def dual_field(targets: Column, needed: Column, name: str, said: Column, intake: Column) -> Column:
    """Required targets that a field by itself does not show."""
    unseen = F.filter(targets, lambda t: F.array_contains(needed, t["id"]) & ~seen(t["text"], said, intake))
    return F.transform(unseen, lambda t: F.concat(F.lit(f"v10_{name}_missing_required:"), t["id"]))


#: The checks of labels.score_records that a reward repeats: null, nothing expected, counts as passed.
REWARDED = {
    "source_cards_present": "expected_source_cards_present", "required_observation_cues_present": "missing_observation_cues_present",
    "candidate_pathways_present": "expected_candidate_pathways_present", "red_flags_match": "red_flags_match",
    "min_urgency_met": "min_urgency_met", "forbidden_behavior_absent": "forbidden_behavior_absent",
}


def reward_vector(version: str, valid: Column, issues: Column, target: Column) -> tuple[Column, Column, Column]:
    """The rewards of a scored output (see labels) as a map, their sum, and whether all are given."""
    active = policies_of(version)
    unmet = lambda name: F.coalesce(F.col(name), F.lit(True))
    closure = F.filter(issues, lambda i: i.rlike(r"^missing_(?:target|referral_sbar|safety_boundaries)_source_card"))
    components = {"schema_valid": valid, **{k: unmet(c) for k, c in REWARDED.items()}}
    components["no_visible_reasoning"] = ~F.lower("output").rlike("</?think")
    components["target_card_present"] = F.array_contains(listed(F.try_parse_json("output"), "source_cards"), target)
    of = next((v for v in ("v6", "v5", "v3", "v2") if v in active), None)
    if of:
        components[f"{of}_policy_pass"] = F.size(F.array_except(issues, closure)) == 0
    if "v7" in active:
        components["v7_source_card_closure_pass"] = F.size(closure) == 0
    return rewards(components)
