"""Agent sessions in JSONL: discovery, first prompts, sanitized events with reasons for what was dropped, export statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.redaction import SUBSTITUTIONS, redact
from sievework.sources.jsonl import numbered_lines

PROMPT_CHARS = 1000


def discover(spark: SparkSession, path: str, folder: str, exclude: tuple[str, ...] = (), source: str | None = "user") -> DataFrame:
    """path, session_id, timestamp, cwd of the sessions whose first session_meta record is of the given folder (case does not count)."""
    lines = numbered_lines(spark, path).where(F.get_json_object("line", "$.type") == "session_meta")
    first = lines.groupBy("path").agg(F.min_by("line", "line_no").alias("m"))
    get = lambda name: F.get_json_object("m", f"$.payload.{name}")
    found = first.select("path", get("id").alias("session_id"), get("timestamp").alias("timestamp"), get("cwd").alias("cwd"), get("source").alias("source"))
    found = found.where((F.lower("cwd") == folder.lower()) & ~F.col("session_id").isin(*exclude) if exclude else F.lower("cwd") == folder.lower())
    return found if source is None else found.where(F.col("source") == source)


def events(spark: SparkSession, path: str) -> DataFrame:
    """path, event_index, type, role, text of each line; a line that is no JSON has type invalid_json."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    get = lambda p: F.try_variant_get(parsed, p, "string")
    content = F.array_join(F.transform(F.try_variant_get(parsed, "$.payload.content", "array<struct<text:string>>"), lambda x: x["text"]), "\n")
    return rows.select(
        "path",
        F.col("line_no").alias("event_index"),
        F.when(parsed.isNull(), "invalid_json").otherwise(F.coalesce(get("$.type"), F.lit("unknown"))).alias("type"),
        get("$.payload.role").alias("role"),
        F.coalesce(F.nullif(content, F.lit("")), get("$.payload.message"), get("$.payload.content")).alias("text"),
    )


def sanitize(df: DataFrame, kept_types: tuple[str, ...], dropped_roles: tuple[str, ...], dumps: tuple[str, ...], substitutions=SUBSTITUTIONS) -> DataFrame:
    """df with drop_reason, null for events that stay, and their text redacted; a text with a dump marker goes whole."""
    text = F.coalesce("text", F.lit(""))
    dumped: Column = F.lit(False)
    for marker in dumps:
        dumped = dumped | F.contains(text, F.lit(marker))
    reason = (
        F.when(F.col("type") == "invalid_json", "invalid_json")
        .when(~F.col("type").isin(*kept_types), F.concat(F.lit("type:"), F.col("type")))
        .when(F.col("role").isin(*dropped_roles), F.concat(F.lit("role:"), F.col("role")))
        .when(dumped, "context_dump")
        .when(F.trim(text) == "", "empty")
    )
    return df.withColumn("drop_reason", reason).withColumn("text", F.when(F.col("drop_reason").isNull(), redact(text, substitutions)))


def first_prompts(df: DataFrame, chars: int = PROMPT_CHARS) -> DataFrame:
    """path, first_prompt: the beginning of the first user text that stays."""
    own = df.where("drop_reason IS NULL AND role = 'user'")
    return own.groupBy("path").agg(F.min_by(F.substring("text", 1, chars), "event_index").alias("first_prompt"))


def export_statistics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events kept and dropped by session, and dropped by reason."""
    by_session = df.groupBy("path").agg(F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count("drop_reason").alias("dropped"))
    return by_session, df.where("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count("*").alias("n"))
