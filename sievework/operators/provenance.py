"""Where each field came from: precedence merge by presence, routes, provenance maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW, REPAIRED, FALLBACK = "model_raw", "model_repaired", "deterministic_fallback"


def merge_by_presence(repaired: Column, raw: Column, fallback: Column, accepted: Column, has_repaired: Column, has_raw: Column) -> Column:
    """struct(value, provenance): repaired if present, else raw if present and accepted, else fallback. Presence counts, not null."""
    use_raw = has_raw & accepted
    return F.when(has_repaired, F.struct(repaired.alias("value"), F.lit(REPAIRED).alias("provenance"))).otherwise(
        F.when(use_raw, F.struct(raw.alias("value"), F.lit(RAW).alias("provenance"))).otherwise(F.struct(fallback.alias("value"), F.lit(FALLBACK).alias("provenance")))
    )


def merge_maps(raw: Column, repaired: Column, fallback: Column, accepted: Column, fields: list[str]) -> Column:
    """array of struct(field, value, provenance) over maps field -> value; a key that is present with null counts as present."""
    def one(field: str) -> Column:
        name = F.lit(field)
        pick = merge_by_presence(
            F.try_element_at(repaired, name), F.try_element_at(raw, name), F.try_element_at(fallback, name),
            F.array_contains(accepted, name), F.map_contains_key(repaired, name), F.map_contains_key(raw, name),
        )
        return F.struct(name.alias("field"), pick["value"].alias("value"), pick["provenance"].alias("provenance"))

    return F.array(*map(one, fields))


def constant_map(fields: list[str], provenance: str) -> Column:
    return F.create_map(*(F.lit(x) for f in fields for x in (f, provenance)))


def has_patches(provenance: Column) -> Column:
    return F.exists(F.map_values(provenance), lambda p: p == FALLBACK)


def summary(provenance: Column) -> Column:
    """struct of counts by class, and rate: the share of fields kept from the model, null without fields."""
    count = lambda c: F.size(F.filter(F.map_values(provenance), lambda p: p == c))
    raw, repaired, patched = count(RAW), count(REPAIRED), count(FALLBACK)
    total = raw + repaired + patched
    return F.struct(raw.alias(RAW), repaired.alias(REPAIRED), patched.alias(FALLBACK), F.try_divide((raw + repaired).cast("double"), F.nullif(total, F.lit(0))).alias("rate"))


def route(called: Column, valid: Column, repaired: Column, patched: Column) -> Column:
    """The final route of a run, first case that holds."""
    return (
        F.when(~called, "deterministic")
        .when(valid & ~repaired & ~patched, "model")
        .when(valid & repaired & ~patched, "model_repaired")
        .when(valid & patched, "mixed")
        .otherwise("fallback")
    )
