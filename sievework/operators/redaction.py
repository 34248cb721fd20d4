"""Redaction by ordered substitutions, and role filters that say why a row went."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal data and secrets, and what replaces them; the order matters.
SUBSTITUTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]+", "[email]"),
    (r"(token|password|secret|api_key) *[=:] *\"?[A-Za-z0-9+/_.-]+\"?", "$1 = [secret]"),
    (r"AKIA[A-Z0-9]+", "[access key]"),
    (r"\+1 \([0-9]+\) [0-9]+-[0-9]+", "[phone]"),
    (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "[address]"),
)


#: Secrets of exported sessions and their marks, in their order.
SESSION_SECRETS = (
    (r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", "<REDACTED_OPENAI_KEY>"),
    (r"\bhf_[A-Za-z0-9]{20,}\b", "<REDACTED_HF_TOKEN>"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "<REDACTED_GITHUB_TOKEN>"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "<REDACTED_GITHUB_TOKEN>"),
    (r"\bglpat-[A-Za-z0-9_-]{20,}\b", "<REDACTED_GITLAB_TOKEN>"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "<REDACTED_SLACK_TOKEN>"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "<REDACTED_GOOGLE_KEY>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<REDACTED_AWS_ACCESS_KEY>"),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/=-]{20,}", "$1<REDACTED_BEARER_TOKEN>"),
    (r"(?i)\b([A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|AUTH)[A-Z0-9_]*\s*[:=]\s*)([\"']?)([^\"'\s,}]{8,})([\"']?)", "$1$2<REDACTED_SECRET>$4"),
)
#: What tells that a whole text is internal context, not talk.
INTERNAL = (
    '"base_instructions"', '\\"base_instructions\\"', '"dynamic_tools"', '\\"dynamic_tools\\"', "========= MEMORY_SUMMARY BEGINS =========",
    "<permissions instructions>", "<app-context>", "<skills_instructions>", "<plugins_instructions>", "<collaboration_mode>",
)
ENVIRONMENT, LONG_CONTEXT = "<environment_context>", 500
SESSION_PATH, SESSION_EVENTS = ".codex/sessions", ('"session_meta"', '"turn_context"', '"response_item"')


def is_internal(text: Column) -> Column:
    """Whether a text is a dump of internal context, to be dropped whole."""
    any_of = lambda marks: reduce(operator.or_, (F.contains(text, F.lit(m)) for m in marks))
    long_context = F.contains(text, F.lit(ENVIRONMENT)) & (F.length(text) > LONG_CONTEXT)
    return any_of(INTERNAL) | long_context | (F.contains(text, F.lit(SESSION_PATH)) & any_of(SESSION_EVENTS))


def redact(text: Column, substitutions: tuple[tuple[str, str], ...] = SUBSTITUTIONS) -> Column:
    for pattern, mark in substitutions:
        text = F.regexp_replace(text, pattern, mark)
    return text


def hits(text: Column, substitutions: tuple[tuple[str, str], ...] = SUBSTITUTIONS) -> Column:
    """How many places the patterns find, each in the text as it is."""
    total = F.lit(0)
    for pattern, _ in substitutions:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def keep_or_drop(df: DataFrame, drops: list[tuple[str, Column]]) -> DataFrame:
    """df with drop_reason: the first condition that holds, or null to keep."""
    reason = F.coalesce(*(F.when(c, F.lit(n)) for n, c in drops))
    return df.withColumn("drop_reason", reason)


def drop_summary(marked: DataFrame) -> DataFrame:
    """reason, n; kept rows are `kept`."""
    return marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
