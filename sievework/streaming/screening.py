"""The stateless operators over streams (an extension: the batch engine has no streams to match)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.screening import Rule, floor, screen


def screen_stream(stream: DataFrame, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """Fired rules and floor of each record as it arrives; no state."""
    return screen(stream, text, rules).withColumn("floor", floor(F.col("fired")))


def floors_by_window(screened: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Records by window and floor, with a watermark for late ones."""
    return screened.withWatermark(time, late).groupBy(F.window(time, width), "floor").agg(F.count("*").alias("n"))
