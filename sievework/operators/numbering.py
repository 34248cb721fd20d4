"""Numbers by order without a global window: rows are dealt by range, and a row's number is its place in its range after the
rows of the ranges before.

Two passes. The first deals by range, sorts within and writes the rows with their place; the second counts the ranges (one
small row each) and adds up. So no task holds the table, and the numbers hold when a task is repeated. The order must tell
rows apart if equal keys are many: rows that are equal in it stay in one range. Nulls come first, as in Spark's order.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.cuts import cut

#: Bits of monotonically_increasing_id that count within a partition.
PLACE_BITS = 33


def number_rows(df: DataFrame, *order: str | Column, into: str = "row_number", start: int = 1) -> DataFrame:
    """df with gapless numbers from start by the order."""
    own = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.select(own, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1).alias("place")), "numbered")
    sizes = dict(placed.groupBy("range").count().collect())  # as many rows as there were partitions
    ranges = sorted(sizes)
    before = dict(zip(ranges, accumulate([start, *(sizes[r] for r in ranges)]), strict=False))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("range")] if before else F.lit(start)
    kept = [c for c in df.columns if c != into]
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), (offset + F.col("place")).cast("long").alias(into))


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], into: str = "position", how: str = "inner") -> DataFrame:
    """The k-th row of one beside the k-th of the other; with how="full" the rest of the longer one too."""
    return number_rows(left, *left_order, into=into).join(number_rows(right, *right_order, into=into), into, how)


def numbered_cases(df: DataFrame, prefix: str, *order: str | Column, into: str = "case_id", width: int = 4) -> DataFrame:
    """Ids by rank, with leading zeros; a number of more digits is not cut."""
    rows = number_rows(df, *order, into=into)
    digits = F.col(into).cast("string")
    return rows.withColumn(into, F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)))


def nth_smallest(df: DataFrame, column: str, n: int, bins: int = 4096) -> int | None:
    """The n-th smallest integer of a column (from 1), nulls left out; None if there are fewer.

    Its range is cut into bins, their rows are counted, and the bin that holds the n-th is cut again: at most six scans of
    partial counts for 64 bits, no sort, and never more than `bins` rows on the driver.
    """
    values = df.select(F.col(column).cast("decimal(20,0)").alias("v")).where("v IS NOT NULL")
    low, high, total = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not 1 <= n <= total:
        return None
    low, high = int(low), int(high)
    while low < high:
        width = -(-(high - low + 1) // bins)
        at = F.expr(f"CAST((v - CAST('{low}' AS DECIMAL(20,0))) DIV CAST('{width}' AS DECIMAL(20,0)) AS LONG)")
        inside = values.where(F.col("v").between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")))
        for r in sorted(inside.groupBy(at.alias("bin")).count().collect()):
            if n <= r["count"]:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            n -= r["count"]
    return low
