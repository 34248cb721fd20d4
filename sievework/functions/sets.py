"""Arrays as sets and as ordered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct members; 0 if either side is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def containment(part: Column, whole: Column) -> Column:
    """The share of the distinct members of `part` found in `whole`; null if there are none."""
    distinct = F.array_distinct(part)
    return F.size(F.array_intersect(distinct, whole)) / F.nullif(F.size(distinct), F.lit(0))


def missing(expected: Column, actual: Column) -> Column:
    """Sorted members of `expected` that `actual` lacks."""
    return F.array_sort(F.array_except(expected, actual))


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value, in order."""
    lowered = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def compact_issues(*issues: Column) -> Column:
    """The issues that are not null, in the order given."""
    return F.array_compact(F.array(*issues))


def priority_first(values: Column, priority: list[str]) -> Column:
    """Members named by the priority list in its order, then the rest in theirs."""
    first = F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(values, p))
    return F.array_distinct(F.concat(first, values))
