"""The ordered severity scale. Comparison treats unknown values in three ways, each under a name of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, lowest first.
LEVELS = ("routine", "monitor", "urgent", "emergency")


def rank(level: Column) -> Column:
    """0 to 3; -1 for an unknown or null value."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1, F.lit(-1))


def level_of(rank_value: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank_value)


def at_least(level: Column, floor: Column) -> Column:
    """An unknown level is below everything, an unknown floor is the lowest."""
    return rank(level) >= F.greatest(rank(floor), F.lit(0))


def meets_expected(level: Column, expected: Column) -> Column:
    """Null without an expectation; an unknown level, or an unknown expectation, fails."""
    return F.when(expected.isNull(), F.lit(None)).otherwise((rank(level) >= 0) & (rank(expected) >= 0) & (rank(level) >= rank(expected)))


def strictly_at_least(level: Column, floor: Column) -> Column:
    """Any unknown value fails."""
    return (rank(level) >= 0) & (rank(floor) >= 0) & (rank(level) >= rank(floor))


def highest(levels: Column) -> Column:
    """The highest level of an array; the lowest of the scale for an empty one."""
    best = F.array_max(F.transform(levels, lambda x: rank(x)))
    return level_of(F.greatest(F.coalesce(best, F.lit(0)), F.lit(0)))
