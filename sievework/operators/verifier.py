"""Verification of training rows: a registry of checks, compiled into one projection over rows joined with their specs.

A check is a name, what it yields (details of each issue, in order) and whether the row is done with if it finds something.
All checks of a stage are Columns, so a row is read once; what a harness rebuilds (prompts, rules, cards) comes from a
function of the caller. The summary is counts by partial sums and the first issues by place, a bounded heap in each task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.jsontext import content_hash
from sievework.operators import labels, output_policies, validation
from sievework.operators.policies import policies_of
from sievework.operators.recovery import fields_of, object_of
from sievework.operators.replay import corrupted, texts
from sievework.sources.cuts import cut

#: Sources that an intake fact may have; evaluation cases that a v5 row must name as excluded.
FACT_SOURCES = ("structured_field", "responder_note", "protocol_card")
EXCLUDED_CASES = ("field_workflow_holdout_v1-000054", "field_workflow_holdout_v1-000099")
SHOWN = 20

Harness = Callable[[DataFrame], DataFrame]


def nothing() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Check:
    """details: an array of texts, one for each issue, or a condition, which is one issue without details."""

    name: str
    details: Column
    stops: bool = False
    condition: bool = True

    def found(self) -> Column:
        one = F.array(F.struct(F.lit(self.name).alias("type"), F.lit(None).cast("string").alias("detail")))
        if self.condition:
            return F.when(self.details, one).otherwise(F.slice(one, 1, 0))
        return F.transform(F.coalesce(self.details, nothing()), lambda d: F.struct(F.lit(self.name).alias("type"), d.alias("detail")))


def compiled(checks: list[Check]) -> Column:
    """array of struct(type, detail): the issues of all checks in order; those after a check that stops are not made."""
    out: Column | None = None
    for check in reversed(checks):
        own = check.found()
        if out is None:
            out = own
        elif check.stops:
            out = F.when(F.size(own) > 0, own).otherwise(out)
        else:
            out = F.concat(own, out)
    return out


def typed(issues: Column, prefix: str) -> Column:
    """Policy issues as struct(type, detail): the policy before the issue; the words of a tripwire are only the detail."""
    kind = lambda i: F.when(F.contains(i, F.lit("forbidden_lexical_tripwire:")), F.lit(f"{prefix}_forbidden_lexical_tripwire")).otherwise(F.concat(F.when(i.rlike("^missing_(?:target|referral_sbar|safety_boundaries)_source_card"), F.lit("v7_")).otherwise(F.lit(f"{prefix}_")), i))
    return F.transform(issues, lambda i: F.struct(kind(i).alias("type"), i.alias("detail")))


def lead_policy(version: str) -> str | None:
    """The policy that a version's issues are named by."""
    active = policies_of(version)
    return next((p for p in ("v6", "v5", "v3", "v2") if p in active), None)


def parsed(rows: DataFrame, row: str) -> DataFrame:
    """rows with what the checks read of the JSON: case_id, category, task_type, base_case_id, version, roles_ok, said, answer, metadata."""
    rows = rows.withColumn("_row", F.try_parse_json("row"))
    r = F.col("_row")
    text = lambda path: F.try_variant_get(r, path, "string")
    messages = F.try_variant_get(r, "$.messages", "array<variant>")
    roles = F.transform(messages, lambda m: F.try_variant_get(m, "$.role", "string"))
    filled = lambda path: F.nullif(text(path), F.lit(""))
    return rows.withColumns(
        {
            "case_id": F.coalesce(text("$.case_id"), F.lit("")),
            "category": F.coalesce(text("$.category"), F.lit("")),
            "task_type": F.coalesce(text("$.metadata.task_type"), F.lit("navigator_full")),
            "base_case_id": F.coalesce(filled("$.metadata.base_case_id"), text("$.case_id"), F.lit("")),
            "row_version": filled("$.version"),
            "roles_ok": F.coalesce(roles == F.array(F.lit("user"), F.lit("assistant")), F.lit(False)),
            "said": text("$.messages[0].content"),
            "answer": text("$.messages[1].content"),
        }
    )


def last_of(df: DataFrame, key: str, order: str, *kept: str) -> DataFrame:
    """The last row of each key, as a dictionary that is filled in order keeps it."""
    return df.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_last")).select(key, "_last.*")


def verify(rows: DataFrame, specs: DataFrame, harness: Harness, repair_prompts: Harness, versions: tuple[str, ...], row: str = "row", spec: str = "spec", position: str = "position") -> DataFrame:
    """position, case_id, category, task_type and issues (array of struct(type, detail)) of every row.

    rows: position (whole numbers from 1) and row (JSON); specs: position and spec (JSON). versions are those whose policies
    are checked; a row of another has none. harness gets rows with spec and must add floor, fired, retrieved, known_cards,
    intake and the intake fields (see validation.validate), prompt and template_hash. repair_prompts gets rows with output,
    scope, failures (of that scope) and fields and must add repair_prompt.
    """
    known = parsed(rows.select(F.col(position).alias("position"), F.col(row).alias("row")), "row")
    s = F.try_parse_json(spec)
    by_id = last_of(specs.select(F.col(position).alias("_at"), F.coalesce(F.try_variant_get(s, "$.case_id", "string"), F.lit("")).alias("base_case_id"), F.col(spec).alias("_spec")), "base_case_id", "_at", "_spec")
    bases = last_of(known.select(F.col("position").alias("_at"), F.col("case_id").alias("base_case_id"), F.col("answer").alias("base_answer"), F.col("category").alias("base_category")), "base_case_id", "_at", "base_answer", "base_category")
    joined = known.join(by_id.withColumnRenamed("_spec", spec), "base_case_id", "left").join(bases.withColumn("has_base", F.lit(True)), "base_case_id", "left")
    stored = F.try_variant_get(F.try_parse_json(spec), "$.dataset_version", "string")
    joined = joined.withColumn("version", F.coalesce("row_version", F.nullif(stored, F.lit("")), F.lit("v1")))
    early = compiled([Check("missing_case_spec", F.col(spec).isNull(), True), Check("messages_must_match_llama_cpp_user_assistant_shape", ~F.col("roles_ok"), True), Check("assistant_content_is_not_json", ~F.coalesce(F.schema_of_variant(F.try_parse_json("answer")).startswith("OBJECT"), F.lit(False)), True)])
    joined = joined.withColumn("issues", early)
    out = ("position", "case_id", "category", "task_type", "issues")
    # Written here and after each stage: plans of many expressions on expressions take the optimizer longer than the rows.
    joined = cut(joined.drop("_row"), "verify-parsed").withColumn("_row", F.try_parse_json("row"))
    refused = joined.where(F.size("issues") > 0)
    sound = cut(harness(joined.where(F.size("issues") == 0).drop("issues", "_row").withColumn("output", F.col("answer"))), "verify-harness").withColumn("_row", F.try_parse_json("row"))
    repairs, whole = sound.where("task_type = 'focused_repair'"), sound.where("task_type <> 'focused_repair'")
    shown = lambda df: df.select(*out)
    return shown(refused).unionByName(shown(verified_whole(whole, versions, spec))).unionByName(shown(verified_repairs(repairs, repair_prompts, versions, spec)))


def common_checks() -> list[Check]:
    low = F.lower("output")
    facts = F.coalesce(F.try_variant_get(F.try_parse_json("output"), "$.intake_facts", "array<variant>"), F.array().cast("array<variant>"))
    odd = F.filter(facts, lambda f: F.schema_of_variant(f).startswith("OBJECT") & ~F.coalesce(F.try_variant_get(f, "$.source", "string").isin(*FACT_SOURCES), F.lit(False)))
    return [
        Check("assistant_contains_visible_reasoning_tag", low.rlike("</?think")),
        Check("assistant_contains_teacher_artifact", F.contains(low, F.lit("teacher"))),
        Check("intake_fact_source_not_in_harness_schema", F.transform(odd, lambda f: F.coalesce(F.try_variant_get(f, "$.source", "string"), F.lit("null"))), condition=False),
    ]


def with_policies(df: DataFrame, versions: tuple[str, ...], spec: str, into: str = "_policy") -> DataFrame:
    """df with the issues of its row's version, typed; output is what is judged."""
    s = F.try_parse_json(spec)
    said = lambda path: F.coalesce(F.try_variant_get(s, path, "string"), F.lit(""))
    case = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.try_variant_get("_row", "$.metadata.failure_class", "string"), F.nullif(said("$.failure_class"), F.lit("")), F.lit(""))
    rows = df.withColumns({"failure_class": case, "expected_flags": texts(s, "$.expected_red_flag_rule_ids"), "expected_pathways": texts(s, "$.expected_candidate_pathway_card_ids"), "target_card": said("$.target_protocol_card_id")})
    rows = rows.withColumn(into, F.array().cast("array<struct<type:string,detail:string>>"))
    for version in versions:
        prefix = lead_policy(version)
        if prefix:
            rows = output_policies.with_policy_issues(rows, version, "_v")
            rows = rows.withColumn(into, F.when(F.col("version") == version, typed(F.col("_v"), prefix)).otherwise(F.col(into))).drop("_v")
    return rows


def metadata_checks(family: str) -> list[Check]:
    """What the metadata of v5 and v6 rows must say."""
    r, out = F.col("_row"), F.try_parse_json("output")
    meta = lambda path: F.try_variant_get(r, f"$.metadata.{path}", "string")
    here = F.col("_family") == family
    lacking = lambda listed, path: F.size(F.array_except(texts(r, f"$.metadata.{listed}"), texts(out, f"$.{path}"))) > 0
    is_list = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(r, f"$.metadata.{path}", "variant")).startswith("ARRAY"), F.lit(False))
    own = lambda name, condition: Check(f"{family}_metadata_{name}", here & condition)
    focus = ~meta("training_focus").eqNullSafe(F.try_variant_get(r, "$.category", "string"))
    selected = output_policies.SELECTED
    if family == "v5":
        return [
            own("dataset_version_missing", ~F.coalesce(meta("dataset_version").endswith("v5"), F.lit(False))),
            own("training_focus_mismatch", focus),
            own("excluded_eval_case_ids_missing", F.size(F.array_except(F.array(*map(F.lit, EXCLUDED_CASES)), texts(r, "$.metadata.excluded_eval_case_ids"))) > 0),
            own("must_include_source_cards_missing", lacking("must_include_source_cards", "source_cards")),
            own(f"must_include_{selected}_missing", lacking(f"must_include_{selected}", selected)),
        ]
    cues = F.transform(texts(r, "$.metadata.harness_metadata_cues_not_observations"), lambda x: F.lower(x))
    version = F.coalesce(F.nullif(meta("dataset_version"), F.lit("")), F.col("row_version"), F.lit(""))
    return [
        own("dataset_version_missing", ~version.rlike(r"(?:^|_)v6")),
        own("training_focus_mismatch", focus),
        own("policy_version_missing", ~F.coalesce(F.try_variant_get(r, "$.metadata.v6_training_policy_version", "double") == 1, F.lit(False))),
        own("required_observation_targets_missing", ~is_list("required_observation_targets")),
        own("harness_cues_missing", ~F.array_contains(cues, "source card ids")),
        own(f"must_include_{selected}_missing", lacking(f"must_include_{selected}", selected)),
    ]


def hash_of(text: Column) -> Column:
    """The content hash of a text: that of its JSON."""
    quoted = F.to_json(F.array(text))
    return content_hash(quoted.substr(F.lit(2), F.length(quoted) - 2))


def verified_whole(rows: DataFrame, versions: tuple[str, ...], spec: str) -> DataFrame:
    family = F.lit(None).cast("string")
    for version in versions:
        name = lead_policy(version) if "v7" not in policies_of(version) else None
        family = F.when(F.col("version") == version, F.lit(name if name in ("v5", "v6") else None)).otherwise(family)
    rows = cut(validation.validate(with_policies(rows, versions, spec).withColumn("_family", family)).drop("_row"), "verify-valid").withColumn("_row", F.try_parse_json("row"))
    s = F.try_parse_json(spec)
    listed = lambda path: texts(s, f"$.{path}")
    fired, retrieved = F.transform("fired", lambda x: x["rule_id"]), F.transform("retrieved", lambda x: x["card_id"])
    out = F.try_parse_json("output")
    evidence = F.struct(
        retrieved.alias("retrieved_card_ids"), fired.alias("deterministic_rule_ids"), F.transform("fired", lambda x: x["card_id"]).alias("deterministic_rule_card_ids"),
        F.col("floor").alias("urgency_floor"), F.when(F.col("passed"), "passed").otherwise("failed").alias("validator_status"), texts(out, "$.source_cards").alias("source_card_ids"),
    )
    expected = ("expected_red_flag_rule_ids", "expected_source_card_ids", "expected_candidate_pathway_card_ids", "expected_model_observation_cues", "expected_handoff_cues", "expected_harness_evidence_cues", "expected_missing_observations", "forbidden_behavior")
    record = F.struct(
        *(listed(k).alias(k) for k in expected),
        *(F.try_variant_get(s, f"$.{k}", "string").alias(k) for k in ("target_protocol_card_id", "expected_min_protocol_urgency")),
        fired.alias("actual_red_flag_rule_ids"), retrieved.alias("retrieved_card_ids"), texts(out, "$.source_cards").alias("actual_source_card_ids"),
        evidence.alias("harness_evidence"), out.alias("final_output"), F.struct("passed", "failures").alias("final_validation"),
    )
    rows = rows.withColumn("_record", F.to_json(record))
    kept = [c for c in rows.columns if c not in ("passed", "failures")]
    named = cut(rows.select(*(c for c in kept if c != "_row"), F.col("passed").alias("_passed"), F.col("failures").alias("_failures")), "verify-records")
    scored = cut(labels.score_records(named, "_record").select(*named.columns, "all_expected_labels_passed"), "verify-scored").withColumn("_row", F.try_parse_json("row"))
    meta = lambda path: F.coalesce(F.try_variant_get("_row", f"$.metadata.{path}", "string"), F.lit(""))
    first = compiled(common_checks()[:2])
    rest = compiled(
        [
            *metadata_checks("v5"),
            *metadata_checks("v6"),
            common_checks()[2],
            Check("user_prompt_does_not_equal_harness_build_prompt", ~F.col("said").eqNullSafe(F.col("prompt"))),
            Check("validator_failed_under_harness", F.when(~F.col("_passed"), F.array(F.array_join("_failures", "; "))).otherwise(nothing()), condition=False),
            Check("expected_label_score_failed", ~F.coalesce("all_expected_labels_passed", F.lit(False))),
            Check("metadata_prompt_hash_mismatch", meta("prompt_hash") != hash_of(F.col("prompt"))),
            Check("metadata_prompt_template_hash_mismatch", meta("prompt_template_hash") != F.col("template_hash")),
            Check("teacher_label_mode_does_not_record_harness_alignment", ~F.contains(meta("teacher_label_mode"), F.lit("harness"))),
        ]
    )
    return scored.withColumn("issues", F.concat(first, "_policy", rest))


def verified_repairs(rows: DataFrame, repair_prompts: Harness, versions: tuple[str, ...], spec: str) -> DataFrame:
    """Rows that repair one scope of their base row's answer: the broken output is made again, validated, and its prompt rebuilt."""
    r = F.col("_row")
    audited = F.coalesce(*(F.try_variant_get(r, f"$.metadata.{k}_replay_audit.accepted", "boolean") for k in ("v7", "v6")), F.lit(False))
    rows = rows.withColumns({"scope": F.coalesce(F.try_variant_get(r, "$.metadata.repair_scope", "string"), F.lit("")), "_repair": F.col("answer"), "has_base": F.coalesce("has_base", F.lit(False))})
    rows = rows.withColumn("output", corrupted(F.col("base_answer"), F.col("scope"), F.col("floor")))
    checked = cut(validation.validate(rows.drop("_row")), "verify-broken").withColumn("_row", F.try_parse_json("row"))
    target = F.coalesce(F.try_variant_get(F.try_parse_json(spec), "$.target_protocol_card_id", "string"), F.lit(""))
    # A closure repair is asked for by the closure issues of the broken output, two other scopes by name.
    wanted = {"source_card_negative_correction": "remove irrelevant or disallowed source card", "observation_patch_repair": "replace scaffold-owned observation fields"}
    cards = texts(F.try_parse_json("output"), "$.source_cards")
    lacking = F.filter(F.array(F.when(target != "", target), F.lit(output_policies.HANDOFF), F.lit(output_policies.SAFETY)), lambda c: c.isNotNull() & ~F.array_contains(cards, c))
    extra = F.when(F.col("scope") == "source_card_closure", F.transform(lacking, lambda c: F.concat(F.lit("source_card_closure:"), c))).otherwise(nothing())
    for name, text in wanted.items():
        extra = F.when(F.col("scope") == name, F.array(F.lit(f"{name}:{text}"))).otherwise(extra)
    own = F.filter(F.concat("failures", extra), lambda f: validation.failure_fields(f)["scope"] == F.col("scope"))
    checked = checked.withColumn("failures", own)
    fields = F.array_distinct(F.flatten(F.transform("failures", lambda f: validation.failure_fields(f)["fields"])))
    asked = repair_prompts(checked.withColumn("fields", fields))
    given, gold = fields_of(F.col("_repair")), fields_of(F.col("base_answer"))
    both = F.map_concat(F.map_filter(gold, lambda k, _: ~F.map_contains_key(given, k)), given)
    rebuilt = object_of(F.transform(F.array_sort(F.map_keys(both)), lambda k: F.struct(k.alias("field"), F.try_element_at(both, k).alias("value"))))
    asked = asked.withColumns({"_broken": F.col("output"), "output": F.coalesce(rebuilt, F.lit("{}"))})
    asked = cut(with_policies(asked, versions, spec).drop("_row"), "verify-repairs").withColumn("_row", F.try_parse_json("row"))
    names = F.coalesce(F.map_keys(given), nothing())
    other = F.concat(F.array_except("fields", names), F.array_except(names, F.col("fields")))
    differs = F.filter("fields", lambda k: ~F.try_element_at(given, k).eqNullSafe(F.try_element_at(gold, k)))
    in_repair = compiled(common_checks()[:2])
    asked = asked.withColumn("output", F.col("_repair"))
    facts = compiled([common_checks()[2]])
    empty = F.size(names) == 0
    replayed = compiled([Check("replay_focused_repair_output_empty", empty), Check("replay_focused_repair_prompt_not_self_contained", ~F.contains(F.lower(F.coalesce("said", F.lit(""))), F.lit("focused field repair only")))])
    normal = F.when(
        F.col("_broken").isNull(), compiled([Check("focused_repair_previous_output_could_not_be_rebuilt", F.lit(True))])
    ).when(F.size("failures") == 0, compiled([Check("focused_repair_prompt_not_generated", F.array("scope"), condition=False)])).otherwise(
        F.concat(
            compiled([Check("focused_repair_output_keys_do_not_match_scope", F.when(F.size(other) > 0, F.array(F.array_join(F.array_sort(other), ","))).otherwise(nothing()), condition=False), Check("focused_repair_field_not_from_base_gold", differs, condition=False)]),
            F.col("_policy"),
            compiled([Check("metadata_prompt_hash_mismatch", F.coalesce(F.try_variant_get(r, "$.metadata.prompt_hash", "string"), F.lit("")) != hash_of(F.col("repair_prompt"))), Check("focused_repair_prompt_does_not_match_harness", ~F.col("said").eqNullSafe(F.col("repair_prompt")))]),
        )
    )
    missing = compiled([Check("focused_repair_missing_base_row", F.array("base_case_id"), condition=False)])
    rest = F.when(F.col("has_base"), normal).when(audited, replayed).otherwise(missing)
    return asked.withColumn("issues", F.concat(in_repair, facts, rest))


def summary(verified: DataFrame, case_specs: int, shown: int = SHOWN) -> DataFrame:
    """One row: rows, case_specs, passed, issue_count, issue_types, categories and task_types (maps, by name), issues_sample
    (the first by position, then by their order in the row)."""
    counts = lambda column: verified.groupBy(column).agg(F.count("*").alias("n"))
    as_map = lambda df, column, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))
    issues = verified.select("position", "case_id", F.posexplode("issues").alias("_at", "_i")).select("position", "case_id", "_at", "_i.type", "_i.detail")
    types = issues.groupBy("type").agg(F.count("*").alias("n"))
    first = issues.orderBy("position", "_at").limit(shown).agg(F.array_sort(F.collect_list(F.struct("position", "_at", "case_id", "type", "detail"))).alias("_s"))
    sample = first.select(F.transform("_s", lambda x: F.struct(x["position"].alias("position"), x["case_id"].alias("case_id"), x["type"].alias("type"), x["detail"].alias("detail"))).alias("issues_sample"))
    rows = verified.agg(F.count("*").alias("rows"))
    parts = [rows, as_map(types, "type", "issue_types"), as_map(counts("category"), "category", "categories"), as_map(counts("task_type"), "task_type", "task_types"), sample]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    total = F.aggregate(F.map_values("issue_types"), F.lit(0).cast("long"), lambda s, x: s + x)
    return one.select("rows", F.lit(case_specs).alias("case_specs"), (total == 0).alias("passed"), total.alias("issue_count"), "issue_types", "categories", "task_types", "issues_sample")
