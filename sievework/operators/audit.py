"""Audits: chat contracts, replay reasons and scores, claims in lines, gates, manifests of row hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.sets import compact_issues


def conversation_shape(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, roles in order, and whether any content is blank."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))))
    rows = turns.groupBy(conv).agg(ordered.alias("_t"))
    return rows.select(conv, F.transform("_t", lambda x: x["role"]).alias("roles"), F.exists("_t", lambda x: x["blank"]).alias("blank"))


def chat_contract(shapes: DataFrame, allowed: tuple[str, ...], first: tuple[str, ...], last: str) -> DataFrame:
    """The shapes with reason: the first clause of the contract that is broken, or null."""
    roles = F.col("roles")
    alternating = F.forall(F.zip_with(roles, F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0))), lambda a, b: b.isNull() | (a != b)), lambda x: x)
    reason = (
        F.when(F.size(F.array_except(roles, F.array(*map(F.lit, allowed)))) > 0, "unknown_role")
        .when(F.col("blank"), "blank_content")
        .when(~F.get(roles, F.lit(0)).isin(*first), "bad_first_role")
        .when(~alternating, "not_alternating")
        .when(F.element_at(roles, -1) != last, "bad_last_role")
    )
    return shapes.withColumn("reason", reason)


def reasons(df: DataFrame, conditions: list[tuple[str, Column]], into: str = "reasons") -> DataFrame:
    """df with an array of the names of the conditions that hold, in order."""
    return df.withColumn(into, compact_issues(*(F.when(c, F.lit(n)) for n, c in conditions)))


def issue_tally(df: DataFrame, issues: str, issue: str = "reason") -> DataFrame:
    return df.select(F.explode_outer(issues).alias(issue)).where(F.col(issue).isNotNull()).groupBy(issue).agg(F.count("*").alias("n"))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no from 1, line."""
    return df.select(key, F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


@dataclass(frozen=True)
class Gate:
    """A claim pattern that needs proof, and the pattern of lines that are safe context."""

    name: str
    claim: str
    safe: str | None = None


def claim_hits(lines: DataFrame, gates: tuple[Gate, ...], proven: DataFrame | None = None) -> DataFrame:
    """Lines that claim a gate outside a safe context; one row for each line and gate, gates proven elsewhere left out."""
    def one(gate: Gate) -> Column:
        hit = F.lower("line").rlike(gate.claim)
        return F.when(hit if gate.safe is None else hit & ~F.lower("line").rlike(gate.safe), F.lit(gate.name))

    hits = lines.withColumn("gate", F.explode_outer(compact_issues(*map(one, gates)))).where("gate IS NOT NULL")
    return hits if proven is None else hits.join(F.broadcast(proven.select("gate").distinct()), "gate", "left_anti")


def gate_rollup(df: DataFrame, **gates: Column) -> DataFrame:
    """gate, passed: whether the condition holds in every row; a null does not hold; no rows, not passed."""
    row = df.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n) for n, c in gates.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("passed")) for n in gates))))


def hash_manifest(df: DataFrame, group: str, key: str, row_hash: Column) -> DataFrame:
    """group, n, and a hash that rows in any order give: the row hashes, each 60 bits of it, summed."""
    part = F.conv(F.substring(row_hash, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.withColumn("_h", part).groupBy(group).agg(F.count("*").alias("n"), F.sum("_h").cast("string").alias("content_sum"), F.min(key).alias("first_key"))
