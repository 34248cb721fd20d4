"""Recovery of outputs that failed validation: rounds of focused repair, merges by field, the hand-off round.

A record's failures are grouped into scopes; a scope is one turn with the model. Rounds are DataFrames: each asks for the
next turn of the records that are still open, judges the replies, and is written, so that calls are not repeated when a
task is. A record leaves when its scopes are used up, when the cap is reached, or, if asked for, as soon as its merged output
is valid. Replies come from a function from DataFrame to DataFrame (see model_calls for one that calls a model).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import provenance
from sievework.operators.validation import REQUIRED, failure_fields, repair_scopes
from sievework.sources.cuts import cut

#: Fixed value: turns of a run that answers a person; None is for batches.
MOST_TURNS = 2
CARD_SCOPES = ("citations_and_pathways", "source_card_closure", "source_card_negative_correction")

#: From turns with key, turn, scope, fields, failures, cards and the record's columns to the same with `reply`, the text of
#: the answer, null if there was none.
Respond = Callable[[DataFrame], DataFrame]
#: From rows with `output` to the same with failures and passed.
Check = Callable[[DataFrame], DataFrame]


def fields_of(output: Column) -> Column:
    """The top-level fields of a JSON object as a map to their JSON texts; null for anything else."""
    return F.transform_values(F.from_json(output, "map<string,variant>"), lambda _, v: F.to_json(v))


def object_of(fields: Column) -> Column:
    """The JSON object of an array of struct(field, value), values being JSON texts; fields without one are left out."""
    present = F.filter(fields, lambda x: x["value"].isNotNull())
    return F.concat(F.lit("{"), F.array_join(F.transform(present, lambda x: F.concat(F.to_json(F.array(x["field"])).substr(F.lit(2), F.length(F.to_json(F.array(x["field"]))) - 2), F.lit(":"), x["value"])), ","), F.lit("}"))


def texts_in(value: Column) -> Column:
    """A JSON text as a list of texts: the members of a list, a string alone, trimmed, blank ones left out."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    none = F.array().cast("array<string>")
    items = F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<string>"), none)).when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(none)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def joined_lists(before: Column, after: Column) -> Column:
    """Two JSON texts as one list in JSON: the texts of both, each once, in order."""
    return F.to_json(F.array_distinct(F.concat(texts_in(before), texts_in(after))))


def plan_turns(records: DataFrame, key: str) -> DataFrame:
    """key, turn (from 1, by each scope's first failure), scope, fields, failures, cards."""
    scopes = repair_scopes(records, key)
    earlier = F.array_sort(F.collect_list("ordinal"))
    order = scopes.groupBy(key).agg(earlier.alias("_order"))
    return scopes.join(order, key).select(key, F.array_position("_order", F.col("ordinal")).cast("int").alias("turn"), "scope", "fields", "failures", "cards")


def judged(turns: DataFrame, raw: str, merge_lists: bool) -> DataFrame:
    """turns with `taken` (the fields that the reply gives, null if it is refused) and `event`, why it is refused."""
    given = turns.withColumn("_fields", fields_of(F.col("reply")))
    cited = texts_in(F.col("_fields")[F.lit("source_cards")])
    is_list = F.schema_of_variant(F.try_parse_json(F.col("_fields")[F.lit("source_cards")])).startswith("ARRAY")
    lacking = F.array_except("cards", F.when(F.coalesce(is_list, F.lit(False)), cited).otherwise(F.array().cast("array<string>")))
    given = given.withColumn("_lacking", F.when(F.col("scope").isin(*CARD_SCOPES), lacking).otherwise(F.array().cast("array<string>")))
    event = (
        F.when(F.col("reply").isNull(), F.concat(F.lit("repair failed for "), "scope"))
        .when(F.col("_fields").isNull(), F.concat(F.lit("repair for "), "scope", F.lit(" returned no object")))
        .when(F.size("_lacking") > 0, F.concat(F.lit("repair omitted mandatory source cards: "), F.array_join("_lacking", ", ")))
    )
    own = F.map_filter("_fields", lambda k, _: F.array_contains("fields", k))
    if merge_lists:
        before = fields_of(F.col(raw))
        joined = F.transform_values(own, lambda k, v: joined_lists(F.try_element_at(before, k), v))
        own = F.when(F.col("scope") == "missing_observations", joined).otherwise(own)
    return given.withColumn("event", event).withColumn("taken", F.when(F.col("event").isNull(), own)).drop("_fields", "_lacking")


def later_wins(maps: Column) -> Column:
    """One map of an array of maps."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(maps, empty, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))


def gathered(answers: DataFrame, key: str) -> DataFrame:
    """key, attempts, repaired (field to JSON text, a later turn's before an earlier one's), events; a record has few turns."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "taken", "event")), lambda a, b: a["turn"] - b["turn"])
    out = answers.groupBy(key).agg(F.count("*").cast("int").alias("attempts"), rows.alias("_rows"))
    taken = F.filter(F.transform("_rows", lambda r: r["taken"]), lambda m: m.isNotNull())
    return out.select(key, "attempts", later_wins(taken).alias("repaired"), F.array_compact(F.transform("_rows", lambda r: r["event"])).alias("events"))


def repair_rounds(records: DataFrame, turns: DataFrame, key: str, respond: Respond, cap: int | None = MOST_TURNS, raw: str = "output", merge_lists: bool = False, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Of each record with a turn: key, scope_count, capped, attempts, repaired, events.

    With check (from rows with `repaired` and the record's columns to the same with `passed`), a record that has become valid is asked no more.
    """
    turns = cut(turns, "repair-turns")
    others = records.drop(*(c for c in turns.columns if c != key))
    most = turns.agg(F.max("turn")).first()[0] or 0
    rounds = most if cap is None else min(cap, most)
    answers: list[DataFrame] = []
    valid: list[DataFrame] = []
    for turn in range(1, rounds + 1):
        frontier = turns.where(F.col("turn") == turn)
        for keys in valid:
            frontier = frontier.join(keys, key, "left_anti")
        asked = respond(frontier.join(others, key))
        answers.append(cut(judged(asked, raw, merge_lists).select(key, "turn", "taken", "event"), f"repair-round-{turn}"))
        if check and turn < rounds:
            so_far = gathered(reduce(DataFrame.unionByName, answers), key)
            now = so_far.join(answers[-1].select(key), key, "left_semi").join(records, key)
            valid.append(cut(check(now).where("passed").select(key), f"repair-valid-{turn}"))
    counts = turns.groupBy(key).agg(F.count("*").cast("int").alias("scope_count"))
    counts = counts.withColumn("capped", F.lit(False) if cap is None else F.col("scope_count") > cap)
    if not answers:
        return counts.withColumns({"attempts": F.lit(0), "repaired": F.create_map().cast("map<string,string>"), "events": F.array().cast("array<string>")})
    found = counts.join(gathered(reduce(DataFrame.unionByName, answers), key), key, "left")
    return found.select(key, "scope_count", "capped", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("repaired", F.create_map().cast("map<string,string>")).alias("repaired"), F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def accepted_fields(failures: Column) -> Column:
    """The fields that no failure is about; none after forbidden language."""
    about = F.flatten(F.transform(failures, lambda f: failure_fields(f)["fields"]))
    forbidden = F.exists(failures, lambda f: failure_fields(f)["scope"] == "forbidden_clinical_language")
    return F.when(forbidden, F.array().cast("array<string>")).otherwise(F.array_except(F.array(*map(F.lit, REQUIRED)), about))


def merged(raw: Column, repaired: Column, fallback: Column, accepted: Column, fields: tuple[str, ...] = REQUIRED) -> Column:
    """array of struct(field, value, provenance), the values JSON texts."""
    empty = F.create_map().cast("map<string,string>")
    return provenance.merge_maps(F.coalesce(fields_of(raw), empty), F.coalesce(repaired, empty), fields_of(fallback), accepted, list(fields))


def settle(records: DataFrame, key: str, check: Check, raw: str = "output", fallback: str = "fallback", fields: tuple[str, ...] = REQUIRED, patched: str | None = None) -> DataFrame:
    """records (with repaired and failures) with output, provenance, passed, failures and event: the first candidate that is valid.

    Candidates are the merge with repaired fields, if there are any, and the merge without; one that keeps nothing of the
    model is none. Else the fallback stands, whatever the check says of it. patched names an array of fields that were
    filled in by rule: their provenance is the fallback's, unless repaired.
    """
    empty = F.create_map().cast("map<string,string>")
    whole = [c for c in records.columns if c not in ("output", "failures", "passed", "provenance", "event")]
    kept = {"_accepted": accepted_fields(F.col("failures")), "_raw": F.coalesce(fields_of(F.col(raw)), empty), "_fallback": fields_of(F.col(fallback))}
    # One candidate after another is tried in the row itself; the check sees the record as it came, with the candidate.
    rows = records.select(F.struct(*records.columns).alias("_record"), *(c.alias(name) for name, c in kept.items()), F.lit(None).alias("_best"))
    used = F.coalesce(F.col("_record.repaired"), empty)
    none = F.array().cast("array<string>")
    patches = F.col("_record")[patched] if patched else none
    for rank, (name, use) in enumerate((("repaired", used), ("patched by field", empty), ("fallback", empty)), 1):
        made = provenance.merge_maps(F.col("_raw") if rank < 3 else empty, use, F.col("_fallback"), F.col("_accepted") if rank < 3 else none, list(fields))
        settled = F.col("_best").isNotNull()
        tried = rows.withColumn("_merged", F.when(~settled, made))
        source = F.map_from_entries(F.transform("_merged", lambda x: F.struct(x["field"], x["provenance"])))
        marked = F.transform_values(source, lambda f, p: F.when(F.array_contains(patches, f) & (p != provenance.REPAIRED), F.lit(provenance.FALLBACK)).otherwise(p))
        told = (object_of(F.col("_merged")), marked) if rank == 1 else (F.when(settled, F.col("_best.output")).otherwise(object_of(F.col("_merged"))), F.when(settled, F.col("_best.provenance")).otherwise(marked))
        tried = tried.withColumns({"output": told[0], "provenance": told[1], "_kept": F.exists("_merged", lambda x: x["provenance"] != provenance.FALLBACK)})
        seen = [F.col("_record")[c].alias(c) for c in records.columns if c not in ("output", "failures", "passed", "provenance")]
        judged_rows = check(tried.select(*rows.columns, *seen, "output", "provenance", "_kept"))
        able = F.lit(True) if rank == 3 else F.col("passed") & F.col("_kept") & (F.lit(True) if rank == 2 else F.size(used) > 0)
        outcome = F.struct("output", "provenance", "passed", "failures", F.lit(name).alias("event"))
        best = F.when(able, outcome) if rank == 1 else F.when(settled, F.col("_best")).when(able, outcome)
        rows = judged_rows.select("_record", *kept, best.alias("_best"))
    return rows.select(*(F.col("_record")[c].alias(c) for c in whole), "_best.*")


def recover(records: DataFrame, key: str, respond: Respond, check: Check, cap: int | None = MOST_TURNS, merge_lists: bool = False, raw: str = "output", fallback: str = "fallback") -> DataFrame:
    """Records whose output failed (with failures, fallback and what check reads), repaired, merged and settled in one."""
    found = repair_rounds(records, plan_turns(records, key), key, respond, cap, raw, merge_lists)
    return settle(records.join(cut(found, "repaired"), key), key, check, raw, fallback)


def handoff_failures(metrics: dict[str, Column]) -> Column:
    """What a hand-off note lacks, as failures that lead to its repair; metrics by name, in name order."""
    found = []
    for name, value in sorted(metrics.items()):
        if name.startswith("sbar_") or name == "handoff_brevity_ok":
            found.append(F.when(~value, F.lit(f"handoff_note_sbar {name} failed")))
        elif name == "handoff_unsupported_fact_count":
            found.append(F.when(value.cast("int") != 0, F.concat(F.lit("handoff_note_sbar unsupported fact count: "), value.cast("string"))))
    return F.array_compact(F.array(F.lit("handoff_note_sbar handoff_readiness_passed failed"), *found))


def handoff_round(records: DataFrame, key: str, respond: Respond, check: Check, ready: Callable[[DataFrame], DataFrame], output: str = "output") -> DataFrame:
    """One more turn for valid outputs whose hand-off note is not ready.

    ready gives rows with `ready` (readiness_passed) and `lacks` (see handoff_failures). A note replaces the former one
    only if the output is then valid and ready; provenance follows. Adds handoff_event: null for records that were ready.
    """
    rows = cut(ready(records), "handoff-ready")
    asked = rows.where("NOT coalesce(ready, false)").withColumns({"turn": F.lit(1), "scope": F.lit("handoff_note_sbar"), "fields": F.array(F.lit("handoff_note_sbar")), "cards": F.array().cast("array<string>")})
    asked = asked.drop("failures").withColumnRenamed("lacks", "failures")
    note = F.try_element_at(fields_of(F.col("reply")), F.lit("handoff_note_sbar"))
    replied = cut(respond(asked).select(key, "reply"), "handoff-replies").withColumn("_note", note)
    usable = F.coalesce(F.schema_of_variant(F.try_parse_json("_note")).startswith("OBJECT"), F.lit(False))
    replied = replied.withColumn("_event", F.when(F.col("reply").isNull(), "backend failed").when(~usable, "no note"))
    before = rows.drop("ready", "lacks")
    tried = before.join(replied.where("_event IS NULL").select(key, "_note"), key)
    fields = F.map_concat(F.map_filter(fields_of(F.col(output)), lambda k, _: k != "handoff_note_sbar"), F.create_map(F.lit("handoff_note_sbar"), F.col("_note")))
    ordered = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k.alias("field"), F.try_element_at(fields, k).alias("value")))
    tried = ready(check(tried.withColumn(output, object_of(ordered)).drop("failures", "passed")))
    good = tried.where("passed AND coalesce(ready, false)").select(key, F.col(output).alias("_output"), F.col("failures").alias("_failures"))
    out = before.join(replied.select(key, F.coalesce("_event", F.lit("not ready")).alias("_event")), key, "left").join(cut(good, "handoff-repaired"), key, "left")
    fixed = F.col("_output").isNotNull()
    marked = F.transform_values("provenance", lambda f, p: F.when(fixed & (f == "handoff_note_sbar"), F.lit(provenance.REPAIRED)).otherwise(p))
    return out.withColumns({output: F.coalesce("_output", output), "provenance": marked, "failures": F.when(fixed, F.col("_failures")).otherwise(F.col("failures")), "handoff_event": F.when(fixed, "repaired").otherwise(F.col("_event"))}).drop("_event", "_output", "_failures")
