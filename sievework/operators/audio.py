"""Audio drafts: field suggestions from transcripts, draft by precedence of source, confirmation by a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.sets import compact_issues
from sievework.functions.text import snippet, spoken_number

#: Fields that a draft may suggest, and values that say nothing.
ALLOWED = ("chief_concern", "patient_age", "pregnancy_status", "symptoms", "vitals", "medications", "allergies", "responder_note")
UNINFORMATIVE = ("", "unknown", "none", "n/a", "not stated", "unclear", "null")
DRAFT, ACCEPTED, EDITED, REJECTED = "audio_draft", "accepted", "edited", "rejected"
SUGGESTION = "array<struct<field:string,draft_value:string,source_snippet:string,source_timecode:string,status:string,needs_confirmation:boolean>>"


def spoken_age(transcript: Column) -> Column:
    """"8 months", "forty two years": number and unit of the first age, digits or words; empty if unknown."""
    low = F.lower(transcript)
    digits = F.regexp_extract(low, r"\b([0-9]{1,3})[ -]*(?:year|month|week|day)s?[ -]*old\b", 1)
    unit = F.regexp_extract(low, r"\b(year|month|week|day)s?[ -]*old\b", 1)
    said = F.regexp_extract(low, r"\b((?:[a-z]+[ -])?[a-z]+)[ -]+(?:year|month|week|day)s?[ -]*old\b", 1)
    number = F.coalesce(F.nullif(digits, F.lit("")), spoken_number(said).cast("string"), spoken_number(F.regexp_extract(said, r"([a-z]+)$", 1)).cast("string"))
    return F.when((unit == "") | number.isNull(), F.lit("")).otherwise(F.concat_ws(" ", number, F.concat(unit, F.lit("s"))))


def suggestion(field: str, value: Column, source: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("draft_value"), source.alias("source_snippet"), F.lit(None).cast("string").alias("source_timecode"), F.lit(DRAFT).alias("status"), F.lit(True).alias("needs_confirmation"))


def suggestions(transcript: Column, keywords: tuple[tuple[str, str, str], ...]) -> Column:
    """Suggestions by keyword: (word, field, value); the first word of a field wins, and the age is read."""
    low = F.lower(transcript)
    fields: dict[str, Column] = {}
    for word, field, value in keywords:
        hit = suggestion(field, F.lit(value), snippet(transcript, word))
        fields[field] = F.when(F.contains(low, F.lit(word)), hit) if field not in fields else fields[field].when(F.contains(low, F.lit(word)), hit)
    age = spoken_age(transcript)
    return compact_issues(F.when(age != "", suggestion("patient_age", age, snippet(transcript, "old"))), *fields.values())


def informative(drafts: Column) -> Column:
    """Drafts of allowed fields that say something."""
    return F.filter(drafts, lambda s: s["field"].isin(*ALLOWED) & ~F.lower(F.trim(F.coalesce(s["draft_value"], F.lit("")))).isin(*UNINFORMATIVE))


def draft(df: DataFrame, keywords: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """transcript, source (provider, typed, canned, unprocessed) and drafts, by that precedence.

    Needs provider_transcript, provider_fields (as SUGGESTION), typed_transcript and canned_transcript, any of them null.
    """
    told = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    source = F.when(told("provider_transcript").isNotNull(), "provider").when(told("typed_transcript").isNotNull(), "typed").when(told("canned_transcript").isNotNull(), "canned").otherwise("unprocessed")
    rows = df.withColumn("source", source).withColumn("transcript", F.coalesce(told("provider_transcript"), told("typed_transcript"), told("canned_transcript"), F.lit("")))
    own = suggestions(F.col("transcript"), keywords).cast(SUGGESTION)
    given = F.coalesce(F.col("provider_fields").cast(SUGGESTION), F.array().cast(SUGGESTION))
    chosen = F.when((F.col("source") == "provider") & (F.size(given) > 0), given).when(F.col("source") == "unprocessed", F.array().cast(SUGGESTION)).otherwise(own)
    return rows.withColumn("drafts", informative(chosen))


def confirm(drafts: Column, edits: Column, rejected: Column) -> Column:
    """Drafts after a person's work: edits (field to value), rejected fields, all others accepted; none waits any more."""

    def one(s: Column) -> Column:
        edit = F.try_element_at(edits, s["field"])
        status = F.when(F.array_contains(rejected, s["field"]), REJECTED).when(edit.isNotNull() & (edit != s["draft_value"]), EDITED).otherwise(ACCEPTED)
        return s.withField("draft_value", F.coalesce(edit, s["draft_value"])).withField("status", status).withField("needs_confirmation", F.lit(False))

    return F.transform(drafts, one)


def merged_field(confirmed: Column, field: str, current: Column) -> Column:
    """A confirmed field: what the record has, else the first draft that was not rejected."""
    kept = F.filter(confirmed, lambda s: (s["field"] == field) & (s["status"] != REJECTED))
    return F.coalesce(F.nullif(F.trim(F.coalesce(current, F.lit(""))), F.lit("")), F.get(kept, F.lit(0))["draft_value"])


def waiting(drafts: Column) -> Column:
    """Whether a draft still needs a person: such a record must not be navigated."""
    return F.exists(drafts, lambda s: s["status"] == DRAFT)


def missing_fields(drafts: Column, wanted: tuple[str, ...]) -> Column:
    have = F.transform(drafts, lambda s: s["field"])
    return F.filter(F.array(*map(F.lit, wanted)), lambda f: ~F.array_contains(have, f))
