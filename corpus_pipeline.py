"""Corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import lines, packing, quality, secrets, similar
from sievework.llm.common import cut, table

#: Stretches that a worker of the packing stage remembers: few, as the stages before have left the JVM beside it large.
MEMO = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of their source go, and documents that fail the base rules or that these lines deplete."""
    return counted(quality.keep_good(docs))


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more different texts go; a group of copies counts once, and near-dedup keeps one of it."""
    return counted(lines.drop_frequent_lines(docs, by_text=True))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity of 0.8 and more stays, that of the smallest doc_id; candidates
    come from the vantage-point trees of the SimHash operator and, beyond its bits, from MinHash bands."""
    return similar.keep_one(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return counted(secrets.redact_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, as a digest."""
    return packing.digest(packing.pack_texts(docs, memo=MEMO))


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_frequent_lines),
    ("near-dedup", one_of_each),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: Tokenizing is beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
