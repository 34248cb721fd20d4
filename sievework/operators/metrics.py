"""Aggregates of evaluation runs: conditional counters, three-valued checks, provenance, latency, error markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of field provenance and the aliases they are written by.
PROVENANCE = ("model_raw", "model_repaired", "deterministic_fallback")
PROVENANCE_ALIASES = {
    "raw_model": "model_raw", "model": "model_raw", "model_generated": "model_raw", "repaired_model": "model_repaired",
    "repair": "model_repaired", "fallback": "deterministic_fallback", "canned_fallback": "deterministic_fallback",
    "deterministic": "deterministic_fallback",
}


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the number of rows, and of those for which each condition is true."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def rate(part: Column, whole: Column) -> Column:
    """Null, not 0, if there is nothing to divide by."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def tally_checks(df: DataFrame, checks: list[str]) -> DataFrame:
    """check, success, failure, not_applicable: true, false and null, counted apart."""
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in checks))
    rows = df.select(F.inline(pairs))
    return rows.groupBy("check").agg(
        F.count_if("value").alias("success"),
        F.count_if(~F.col("value")).alias("failure"),
        F.count_if(F.col("value").isNull()).alias("not_applicable"),
    )


def all_applicable(*checks: Column) -> Column:
    """Whether all checks that apply hold; null if none applies."""
    applicable = F.array_compact(F.array(*checks))
    return F.when(F.size(applicable) == 0, F.lit(None).cast("boolean")).otherwise(F.forall(applicable, lambda x: x))


def provenance_class(value: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PROVENANCE_ALIASES.items() for x in pair))
    low = F.lower(value)
    return F.coalesce(F.try_element_at(table, low), low)


def provenance_counts(df: DataFrame, column: str) -> DataFrame:
    """class, n and share of all."""
    counted = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("class", "n", F.round(rate(F.col("n"), F.col("total")), 6).alias("share"))


def provenance_by_field(df: DataFrame, field: Column, column: str, classes: tuple[str, ...]) -> DataFrame:
    """One row for each field, one count for each class."""
    return df.groupBy(field.alias("field")).agg(*(F.count_if(F.col(column) == c).alias(c) for c in classes))


def latency_summary(df: DataFrame, value: str, *group: str) -> DataFrame:
    """n, min, mean, p50, p95 and max, to three digits; percentiles by linear interpolation."""
    three = lambda c, name: F.round(c, 3).alias(name)
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        three(F.min(value), "min"),
        three(F.avg(F.col(value).cast("decimal(18,6)")).cast("double"), "mean"),
        three(F.percentile(value, 0.5), "p50"),
        three(F.percentile(value, 0.95), "p95"),
        three(F.max(value), "max"),
    )


def error_markers(df: DataFrame, key: str, text: Column, markers: tuple[str, ...]) -> DataFrame:
    """marker, seen, n_affected and the least affected key. Counts of kinds are rows with seen."""
    hits = df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), F.contains(F.lower(text), F.lit(m)).alias("hit")) for m in markers))).alias("m"))
    affected = F.when(F.col("m.hit"), F.col(key))
    return hits.groupBy("m.marker").agg(F.bool_or("m.hit").alias("seen"), F.count(affected).alias("n_affected"), F.min(affected).alias("first_affected"))


def value_counts(df: DataFrame, values: str, name: str) -> DataFrame:
    """How often each member of an array column occurs."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
