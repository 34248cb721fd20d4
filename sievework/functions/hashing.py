"""Content hashes that do not depend on the engine: canonical JSON of columns, row and split keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """The named columns as one JSON object, names sorted, nulls written."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def stable_hash(*columns: str, digits: int = 16) -> Column:
    return F.substring(F.sha2(canonical_json(*columns), 256), 1, digits)


def row_hash(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 of the parts as text; a null part is a visible marker."""
    shown = [F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    return F.sha2(F.concat_ws(separator, *shown), 256)


def split_key(seed: str, key: Column) -> Column:
    """The order of a seeded split."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
