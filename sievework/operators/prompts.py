"""Prompts as projections: allowed facts, compact cards, prompt text and template hash, repair prompts by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.intake import FIELDS


def allowed_facts(df: DataFrame, key: str) -> DataFrame:
    """key, ordinal, kind (intake, rule, card), source, fact: everything an output may rest on."""
    fields = F.filter(F.array(*(F.struct(F.lit("intake").alias("kind"), F.lit(f).alias("source"), F.trim(F.coalesce(F.col(f), F.lit(""))).alias("fact")) for f in FIELDS)), lambda x: x["fact"] != "")
    rules = F.transform("fired", lambda r: F.struct(F.lit("rule").alias("kind"), r["rule_id"].alias("source"), F.concat_ws(": ", r["label"], r["evidence"]).alias("fact")))
    cards = F.flatten(F.transform("retrieved", lambda c: F.transform(c["required_observations"], lambda o: F.struct(F.lit("card").alias("kind"), c["card_id"].alias("source"), o.alias("fact")))))
    return df.select(key, F.posexplode(F.concat(fields, rules, cards)).alias("ordinal", "_f")).select(key, "ordinal", "_f.kind", "_f.source", "_f.fact")


def mandatory_cards() -> Column:
    """Cards of fired rules, then the hand-off and safety cards among the retrieved ones."""
    fixed = F.array(F.lit("REFERRAL-SBAR-v1"), F.lit("SAFETY-BOUNDARIES-v1"))
    return F.array_union(F.array_distinct(F.transform("fired", lambda r: r["card_id"])), F.array_intersect(fixed, F.transform("retrieved", lambda c: c["card_id"])))


def compact_card(columns: tuple[str, ...], most: int) -> Column:
    """A card's lists cut to a few entries each, as JSON."""
    return F.to_json(F.struct(F.col("card_id"), F.col("title"), *(F.slice(F.col(c), 1, most).alias(c) for c in columns)))


def prompt(system: str, *sections: tuple[str, Column]) -> tuple[Column, Column]:
    """The prompt text, and the template hash, which is of the system text only."""
    body = [F.concat(F.lit(f"## {title}\n"), F.coalesce(c, F.lit(""))) for title, c in sections]
    return F.concat_ws("\n\n", F.lit(system), *body), F.substring(F.sha2(F.lit(system), 256), 1, 16)


def repair_prompts(scopes: DataFrame, original: Column, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """scopes (see validation.repair_scopes, joined with what `original` needs) with one prompt each: what failed, which fields to return."""
    table = F.create_map(*(x for scope, names in fields.items() for x in (F.lit(scope), F.lit(", ".join(names)))))
    lines = F.array_join(F.transform("failures", lambda f: F.concat(F.lit("- "), f)), "\n")
    text = F.concat_ws("\n\n", original, F.concat(F.lit("These checks failed:\n"), lines), F.concat(F.lit("Return JSON with only these fields: "), F.coalesce(F.try_element_at(table, F.col("scope")), F.lit("all"))))
    return scopes.withColumn("prompt", text)
