"""JSON and JSONL: scans with file and line, strict and missing-tolerant; sinks with sorted keys, append by key, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CARD = (
    "card_id string, title string, applies_to array<string>, required_observations array<string>, red_flags array<string>, "
    "escalation_criteria array<string>, local_actions array<string>, forbidden_actions array<string>, safety_boundary string, source_note string"
)


def scan_cards(spark: SparkSession, folder: str) -> DataFrame:
    """One card a file, with file_name; order by it where order matters."""
    return spark.read.schema(CARD).option("multiLine", True).json(f"{folder}/*.json").withColumn("file_name", F.col("_metadata.file_name"))


def known_keys(cards: DataFrame, key: str = "card_id") -> DataFrame:
    return cards.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (physical, from 1, blank lines counted) and line. A file is read whole, so that its lines can be numbered."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("_p", "line"))
    return rows.select("path", (F.col("_p") + 1).alias("line_no"), "line")


def scan_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rows with _case_path and _case_line; strict: bad JSON or a value that is no object fails the job, naming the line."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("_row", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    if strict:
        fine = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
        where = F.concat(F.lit("not a JSON object: "), "path", F.lit(":"), F.col("line_no").cast("string"))
        parsed = parsed.withColumn("_bad", F.assert_true(fine, where)).where(F.col("_bad").isNull())
    return parsed.select("_row.*", F.col("path").alias("_case_path"), F.col("line_no").alias("_case_line"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or anything its pattern names, exists in whatever store it is."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


def scan_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent file is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_record(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path and the first JSON record of the given type in each file."""
    lines = numbered_lines(spark, path).where(F.try_parse_json("line").isNotNull())
    typed = lines.where(F.get_json_object("line", "$.type") == kind)
    return typed.groupBy("path").agg(F.min_by("line", "line_no").alias("record"))


def sorted_keys(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Keys sorted, nulls written. One file only for results known to be small."""
    out = sorted_keys(df)
    (out.coalesce(1) if one_file else out).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key is not there yet."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    write_jsonl(df, path, mode="append")


def evidence_bundle(records: DataFrame, path: str, key: str, hash_column: str) -> DataFrame:
    """Writes the records and one row about them: how many, how many lack a hash, whether all have one."""
    write_jsonl(records, f"{path}/records", mode="overwrite")
    found = F.count(hash_column)
    summary = records.agg(F.count("*").alias("n"), (F.count("*") - found).alias("missing"), (F.count("*") == found).alias("all_present"), F.min(key).alias("first"))
    write_jsonl(summary, f"{path}/manifest", one_file=True, mode="overwrite")
    return summary
