"""What several operators share: tables, written cuts, row keys, Arrow batch limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.cuts import cut, discard, own_dir, shared_dir
from sievework.sources.tables import read_table

__all__ = ["WHITE", "bounded_batches", "cut", "discard", "latin_lower", "own_dir", "row_key", "shared_dir", "table", "text_of", "whole_rows"]

#: ASCII white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one, so that no working column can clash with one of them."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: very long texts must not add up to gigabytes in one batch. It holds for the session, as
    results are computed only after the operator has returned; a smaller setting of the caller's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str, text: Column) -> Column:
    """16 bytes that identify a document row by id and text; a null id counts as a value of its own."""
    label = F.coalesce(F.concat(F.lit("#"), F.col(id_column).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(label, F.lit("\n"), text).cast("binary")))


def latin_lower(text: Column) -> Column:
    """A key that is equal for two texts exactly if they differ only in the case of A-Z.

    The UTF-8 bytes are read as Latin-1 and lower-cased. Besides A-Z that maps the lead bytes C3-DE to E3-FE; as the
    number of continuation bytes still tells these apart, different texts keep different keys.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
