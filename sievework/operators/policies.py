"""Versioned corpus policies: which apply to a dataset version, issues they raise, rewards, acceptance, replay audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.sets import compact_issues
from sievework.functions.text import normalize, slug

#: Which versions carry the policies of which others.
IMPLIES = {"v14": ("v13",), "v13": ("v10",), "v12": ("v10",), "v11": ("v10",), "v10": ("v9",), "v9": ("v8",), "v8": ("v7",), "v7": ("v6",), "v6": ("v3",), "v5": ("v3",), "v4": ("v3",), "field_workflow_holdout": ("v3",)}


def policies_of(version: str) -> tuple[str, ...]:
    """The policies of a dataset version, by longest prefix and implication; v2 by equality, v1 if nothing else."""
    if version == "v2":
        return ("v2",)
    start = next((p for p in sorted([*IMPLIES, "v3"], key=len, reverse=True) if version.startswith(p)), None)
    if start is None:
        return ("v1",)
    found, waiting = [], [start]
    while waiting:
        name = waiting.pop(0)
        if name not in found:
            found.append(name)
            waiting += IMPLIES.get(name, ())
    return tuple(found)


@dataclass(frozen=True)
class Policy:
    """Named conditions on a row; a condition that holds is an issue."""

    name: str
    issues: tuple[tuple[str, Column], ...]


def issues(policies: tuple[Policy, ...], version: str) -> Column:
    """The issues of all policies that the version carries, in the order of the policies."""
    active = policies_of(version)
    return compact_issues(*(F.when(c, F.lit(f"{p.name}:{n}")) for p in policies if p.name in active for n, c in p.issues))


def mostly_generic(items: Column, pattern: str) -> Column:
    """At least three, and at least half, of the items are generic."""
    generic = F.size(F.filter(items, lambda x: F.lower(x).rlike(pattern)))
    return generic >= F.greatest(F.lit(3), F.floor(F.size(items) / 2).cast("int"))


def thin_note(note: Column, least: int = 6) -> Column:
    """Whether a slot of a hand-off note is shorter than that."""
    parts = [F.length(F.trim(F.coalesce(note[s], F.lit("")))) < least for s in ("situation", "background", "assessment_observations_only", "handoff_request")]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def same_long_lists(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two long lists say the same in the same order."""
    flat = lambda xs: F.transform(xs, lambda x: normalize(x))
    return (F.size(a) >= least) & (flat(a) == flat(b))


def retrieval_gap(version: str, retrieved: Column, fired: Column, wanted: Column) -> Column:
    """struct(reason, missing) of a case whose cards were not retrieved, or null: first those of fired rules (not asked for under
    the policies v5 and v6), then the expected pathways, under these but for the cards of fired rules."""
    active = {"v5", "v6"} & set(policies_of(version))
    cards = F.filter(F.transform(fired, lambda c: F.trim(c)), lambda c: F.coalesce(c, F.lit("")) != "")
    lacks = lambda ids: F.array_sort(F.array_except(ids, retrieved))
    rules = F.array().cast("array<string>") if active else lacks(cards)
    pathways = F.array_except(lacks(wanted), cards) if active else lacks(wanted)
    told = lambda reason, ids: F.when(F.size(ids) > 0, F.struct(F.lit(reason).alias("reason"), ids.alias("missing")))
    return F.coalesce(told("rule_card_not_retrieved_by_harness", rules), told("target_card_not_retrieved_by_harness", pathways))


def note_contract(lists: dict[str, tuple[Column, int]], note: Column, script: Column) -> Column:
    """Issues of teacher notes: list minima, the four slots, the script."""
    return compact_issues(
        *(F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) < n, F.lit(f"{name} has fewer than {n}")) for name, (c, n) in lists.items()),
        F.when(note.isNull() | thin_note(note, 1), F.lit("note slot missing")),
        F.when(F.trim(F.coalesce(script, F.lit(""))) == "", F.lit("script missing")),
    )


def rewards(components: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The vector as a map to 0 or 1 (null is 0), its sum, and whether all hold."""
    numbers = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in components.items()}
    vector = F.create_map(*(x for n, c in numbers.items() for x in (F.lit(n), c)))
    total = F.aggregate(F.map_values(vector), F.lit(0), lambda s, x: s + x)
    return vector, total, F.forall(F.map_values(vector), lambda x: x == 1)


def rejection_key(*causes: Column, most: int = 120) -> Column:
    """The first thing that failed, as a counter's key."""
    return slug(F.coalesce(*causes, F.lit("unknown")), most)


def candidate_attributes(row: Column) -> dict[str, Column]:
    """Attributes of a training row in JSON, each from the first place that has it."""
    v = F.try_parse_json(row)
    get = lambda *paths: F.coalesce(*(F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths), F.lit("unknown"))
    return {
        "case_id": get("$.uuid", "$.case_id", "$.metadata.case_id"),
        "category": get("$.category", "$.metadata.category", "$.metadata.failure_class"),
        "task_type": get("$.metadata.task_type", "$.metadata.repair_scope"),
        "source_version": get("$.metadata.original_source_dataset_version", "$.metadata.dataset_version", "$.version"),
        "target_card": get("$.metadata.target_protocol_card_id", "$.target_protocol_card_id"),
    }
