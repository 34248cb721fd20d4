"""Line dedup with DataFrame functions only: lines are exploded as hashes, documents counted for each, and the lines of
frequent keys dropped by position.

Only 16-byte hashes travel to the counts; the text itself is shuffled once, by document, where its dropped positions join
it. A key that a third of all documents share is counted from partial sums spread over all tasks. doc_id tells documents
apart (rows with one doc_id count as one document, a null doc_id as a document of its own); a null or empty text is one
empty line. Other columns pass through, whatever their names; n_lines and n_dropped of df are replaced. With by_text, equal texts count as one document instead, so that a group of copies does
not make its own lines frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WHITE, cut, latin_lower, row_key, text_of, whole_rows

DOCUMENTS = 10
LEAST_CHARS = 1


def line_keys(text: Column) -> Column:
    """An array of the key of each line: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(latin_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))


def dropped_lines(df: DataFrame, text: str = "text", documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS, by_text: bool = False) -> DataFrame:
    """For each row key (see common.row_key) the positions, from 0, of the lines to drop; rows without any are left out."""
    body = text_of(text)
    # An outer explode: of a plain one the optimizer infers a filter on the size and splits the text twice.
    # A key has one character for each byte; code points are the bytes that do not continue one.
    chars = F.length("line") if least_chars <= 1 else F.length(F.regexp_replace("line", "[\u0080-\u00bf]", ""))
    unit = F.unhex(F.md5(body.cast("binary"))) if by_text else F.struct("doc_id")
    lines = (
        df.select(unit.alias("unit"), row_key("doc_id", body).alias("row_key"), F.posexplode_outer(line_keys(body)).alias("position", "line"))
        .where(chars >= least_chars)
        .select("unit", "row_key", "position", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    )
    counted = lines.groupBy("key").agg(F.countDistinct("unit").alias("n"))
    # Written, so that the join knows its size: small, it is broadcast; large, both sides are exchanged and AQE splits a hot key.
    frequent = cut(counted.where(F.col("n") >= documents).select("key"), "frequent-lines")
    hits = lines.join(frequent, "key", "left_semi")
    return hits.groupBy("row_key").agg(F.collect_set("position").alias("dropped"))


def drop_frequent_lines(df: DataFrame, text: str = "text", documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS, by_text: bool = False) -> DataFrame:
    """df with its texts rebuilt by position without the lines of frequent keys, and n_lines and n_dropped added."""
    drops = dropped_lines(df, text, documents, least_chars, by_text)
    body = text_of(text)
    rows = df.select(whole_rows(df).alias("row"), row_key("doc_id", body).alias("row_key"))
    # The lines are a column of their own, used more than once, so they are split once for each row and read by position.
    split = rows.join(drops, "row_key", "left").withColumn("lines", F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    new = F.when(F.col("dropped").isNull(), F.col("row").getField(text)).otherwise(rebuilt)
    gone = F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long")
    columns = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return split.select(*columns, F.size("lines").cast("long").alias("n_lines"), gone.alias("n_dropped"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))
