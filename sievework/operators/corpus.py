"""Corpus building: scenarios, coerced and corrupted outputs, corrected labels, repair rows, recovery, token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.sets import compact_issues
from sievework.functions.text import normalize

IGNORED = -100


def pick(values: Column, index: Column) -> Column:
    """The member at an index modulo the size; null for an empty array."""
    return F.get(values, F.pmod(index, F.nullif(F.size(values), F.lit(0))).cast("int"))


def scenarios(spark: SparkSession, start: int, count: int, stride: int, dims: dict[str, list[str]]) -> DataFrame:
    """index and one column for each dimension, all a function of the index alone: any shard makes its own rows."""
    rows = spark.range(start, start + count * stride, stride).withColumnRenamed("id", "index")
    at, spread = F.col("index"), 1
    for name, values in dims.items():
        rows = rows.withColumn(name, pick(F.array(*map(F.lit, values)), F.floor(at / F.lit(spread))))
        spread *= len(values)
    return rows


def unfinished(shards: DataFrame, done: DataFrame, key: str, size: str) -> DataFrame:
    """Shards that are not there with as many rows as they should have."""
    whole = done.groupBy(key).agg(F.count("*").alias("_n"))
    joined = shards.join(whole, key, "left")
    return joined.where(F.coalesce("_n", F.lit(0)) < F.col(size)).drop("_n")


def coerced_list(output: Column, field: str) -> Column:
    """A list field of a JSON output: a string becomes a list of one, anything else but a list becomes empty."""
    value = F.try_variant_get(F.try_parse_json(output), f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    strings = F.coalesce(F.try_variant_get(value, "$", "array<string>"), none)
    one = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(kind.startswith("ARRAY"), strings).when((kind == "STRING") & (one != ""), F.array(one)).otherwise(none)


def coerced_text(output: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(output), f"$.{field}", "string"), F.lit(""))


def soften(text: Column, rules: tuple[tuple[str, str], ...], most: int = 360) -> Column:
    """Ordered substitutions without regard to case, white space collapsed, dashes stripped, cut."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, f"(?i){pattern}", replacement)
    return F.substring(F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), F.lit(" -")), 1, most)


def removed_cards(before: Column, after: Column, card_of: dict[str, str]) -> Column:
    """Cards of the rules that no longer fire."""
    table = F.create_map(*(F.lit(x) for pair in card_of.items() for x in pair))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array_except(before, after), lambda r: F.try_element_at(table, r)))))


def corrected_cards(expected: Column, removed: Column, target: Column, current: Column) -> Column:
    """Expected cards without removed ones, unless the target or current rules name them; current cards are added, sorted."""
    kept = F.filter(expected, lambda c: ~F.array_contains(removed, c) | c.eqNullSafe(target) | F.array_contains(current, c))
    return F.concat(kept, F.array_sort(F.array_except(current, kept)))


def corrected_cues(expected: Column, of_removed: Column, of_kept: Column) -> Column:
    """Expected cues without those that only removed cards ask for."""
    flat = lambda xs: F.transform(xs, lambda x: normalize(x))
    return F.filter(expected, lambda c: ~F.array_contains(flat(of_removed), normalize(c)) | F.array_contains(flat(of_kept), normalize(c)))


def changed_counts(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each named pair of columns how many rows differ (null is a value), and how many differ in any."""
    different = {n: ~F.col(a).eqNullSafe(F.col(b)) for n, (a, b) in pairs.items()}
    anything = F.lit(False)
    for c in different.values():
        anything = anything | c
    return df.agg(*(F.count_if(c).alias(n) for n, c in different.items()), F.count_if(anything).alias("any"))


def training_row(case_id: Column, prompt: Column, answer: Column, metadata: dict[str, Column]) -> Column:
    """A chat row: id, the two messages, metadata."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.struct(case_id.alias("case_id"), F.array(turn("user", prompt), turn("assistant", answer)).alias("messages"), F.struct(*(c.alias(n) for n, c in metadata.items())).alias("metadata"))


def row_issues(messages: Column, key: Column) -> Column:
    """The contract of a chat row: exactly user and assistant, contents that say something, an id."""
    roles = F.transform(messages, lambda m: m["role"])
    blank = F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == "")
    return compact_issues(F.when(roles != F.array(F.lit("user"), F.lit("assistant")), F.lit("roles")), F.when(blank, F.lit("blank_content")), F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.lit("missing_id")))


def masked_tokens(prompt: Column, answer: Column, most: int) -> Column:
    """struct of ids and labels: the prompt is not learned (IGNORED); what is too long loses its beginning."""
    ids = F.concat(prompt, answer)
    labels = F.concat(F.transform(prompt, lambda x: F.lit(IGNORED)), answer)
    cut = lambda xs: F.when(F.size(xs) > most, F.slice(xs, F.size(xs) - most + 1, F.lit(most))).otherwise(xs)
    return F.struct(cut(ids).alias("ids"), cut(labels).alias("labels"))


def triage(df: DataFrame, scopes: dict[str, str], model_checks: tuple[str, ...], embargo: Column) -> DataFrame:
    """df with repair_scopes (of failed checks, in order), harness_only, seed_type and kept.

    scopes maps a check to the scope that repairs it. A case that failed only in checks that are not the model's is
    harness_only; one that passed all that apply is a replay; embargoed cases are never seeds.
    """
    failed = [F.when(~F.col(c), F.lit(s)) for c, s in scopes.items()]
    model_failed = F.lit(False)
    for c in model_checks:
        model_failed = model_failed | F.coalesce(~F.col(c), F.lit(False))
    rows = df.withColumn("repair_scopes", F.array_distinct(F.array_compact(F.array(*failed))))
    rows = rows.withColumn("harness_only", (F.size("repair_scopes") > 0) & ~model_failed)
    kind = F.when(embargo, "embargoed").when(F.col("harness_only"), "harness_only").when(F.size("repair_scopes") > 0, "repair").otherwise("replay")
    return rows.withColumn("seed_type", kind).withColumn("kept", kind.isin("repair", "replay"))
