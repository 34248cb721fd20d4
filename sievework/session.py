"""The session settings that the operators expect; a cluster's own settings win."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def reach_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where it lies, wherever the driver was started. On a cluster the package is installed, or shipped with --py-files; the path then does no harm."""
    environment, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([own, *paths])
    return spark


def local_session(cores: int | str = "*", memory: str = "6g", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; keyword settings use _ for . in their names."""
    conf = SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", "8")
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return reach_package(session)
