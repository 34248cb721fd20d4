"""Scans of the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows cost much work each.
HEAVY = ("documents", "pages")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. A heavy one in fewer files than there are cores is dealt out once, after filters and column pruning
    have reached the scan; with more files, as on a cluster, its splits are the partitions."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and len(found.inputFiles()) < cores:
        return found.repartition(cores)
    return found


def fixed(spark: SparkSession, rows: tuple[tuple, ...], *names: str) -> DataFrame:
    """A table of rows known beforehand. Of one made from a Python list the optimizer does not know the size, so it is never small."""
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))))


#: Bytes up to which a side of a join is broadcast by `small`.
BROADCAST_BYTES = 4 << 20


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's estimate of a table's size is within bounds. It is made while planning: nothing runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def small(df: DataFrame, source: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it, or the table it is made of, is small; else df, to be shuffled."""
    return F.broadcast(df) if is_small(source or df, most) else df
