"""Screening of confirmed intake records: context predicates, the default field rules, severity floor."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.sets import compact_issues
from sievework.operators.screening import first_match, first_unnegated, floor, record_text

FIELDS = ("setting", "patient_age", "pregnancy_status", "chief_concern", "symptoms", "vitals", "allergies", "medications", "available_supplies", "responder_note")
QUERY_FIELDS = tuple(f for f in FIELDS if f not in ("allergies", "medications"))

#: The cues of each rule, in the order in which they give evidence.
CUES = {
    "AMS-001": (r"\baltered mental status\b", r"\bnew confusion\b", r"\bconfus(?:ed|ion)\b", r"\bunresponsive\b", r"\bdifficult to (?:wake|arouse)\b", r"\bnew seizure\b"),
    "RESP-001": (r"\bsevere respiratory distress\b", r"\bgasping\b", r"\bunable to speak(?: full sentences)?\b", r"\bblue lips\b", r"\bcyanosis\b", r"\bmarked retractions\b", r"\btripod position(?:ing)?\b"),
    "PREG-001": (r"\bvaginal bleeding\b", r"\bbleeding\b", r"\bseizure\b", r"\bfainting\b", r"\bsevere headache\b", r"\bvision changes?\b", r"\bsevere abdominal pain\b"),
    "red_flag_chest_pain": (r"\bchest pain\b", r"\bchest pressure\b", r"\bpain radiat(?:es|ing) to (?:arm|jaw|back|shoulder)\b", r"\bchest pain with (?:shortness of breath|sweating|fainting|severe weakness)\b"),
    "STROKE-001": (r"\bfacial droop\b", r"\bface droop\b", r"\bone[- ]sided weakness\b", r"\barm weakness\b", r"\bslurred speech\b", r"\btrouble speaking\b", r"\bsudden vision change\b", r"\bsudden balance trouble\b"),
    "PED-DEHYD-001": (r"\bletharg(?:ic|y)\b", r"\bdifficult to arouse\b", r"\bno urine\b", r"\bsunken eyes\b", r"\bvery dry mouth\b", r"\bpoor perfusion\b", r"\bunable to keep fluids down\b"),
    "FEVER-001": (r"\bstiff neck\b", r"\bconfus(?:ed|ion)\b", r"\baltered mental status\b", r"\bnon[- ]blanching rash\b", r"\brapidly spreading rash\b", r"\bsevere dehydration\b"),
    "WOUND-001": (r"\bspreading redness\b", r"\bred streak(?:ing|s)?\b", r"\bpus\b", r"\bfoul drainage\b", r"\brapidly worsening pain\b", r"\bworsening swelling\b"),
}
#: Label, severity and card of each rule, in the order of the checks.
TABLE = (
    ("AMS-001", "Altered mental status", "emergency", "AMS-RED-FLAGS-v1"),
    ("RESP-001", "Respiratory distress", "emergency", "RESP-DISTRESS-RED-FLAGS-v1"),
    ("PREG-001", "Pregnancy danger sign", "emergency", "PREG-DANGER-SIGNS-v1"),
    ("red_flag_chest_pain", "Chest pain escalation cue", "emergency", "CHEST-PAIN-ESCALATION-v1"),
    ("STROKE-001", "Stroke sign", "emergency", "STROKE-SIGNS-v1"),
    ("PED-DEHYD-001", "Pediatric dehydration red flag", "urgent", "PED-DEHYD-RED-FLAGS-v1"),
    ("FEVER-001", "Fever escalation cue", "urgent", "FEVER-RED-FLAGS-v1"),
    ("WOUND-001", "Wound infection escalation cue", "urgent", "WOUND-INFECTION-ESCALATION-v1"),
)
#: Fixed values of the context predicates.
NOT_PREGNANT = ("", "n/a", "na", "no", "none", "not applicable", "not pregnant", "nonpregnant", "non pregnant", "unknown")
PREGNANT = r"\b(?:pregnant|pregnancy|postpartum)\b"
DENIES_PREGNANCY = r"\b(?:not|no|denies|is not|isn't)\s+(?:currently\s+)?pregnan\w*\b|\bnon[- ]pregnan\w*\b"
STATUS_DENIES = r"\b(?:not|no|denies)\s+(?:currently\s+)?pregnan\w*\b"
CHILD = r"\b(?:child|infant|toddler|baby|pediatric)\b"
MEASURED_FEVER = r"\b(?:temperature|temp)\s*(?:of|is|:|now|currently|measured|at)?\s*(?:10[0-9](?:\.\d+)?\s*f|3[89](?:\.\d+)?\s*c|40(?:\.\d+)?\s*c)\b"
FEVER = re.compile(r"\b(?:fever|febrile)\b")
NO_FEVER = re.compile(r"\b(?:no|not|denies|without)\s+(?:current(?:ly)?\s+|reported\s+)?(?:fever|febrile)\b")
WOUND = r"\bwound\b|cut|laceration|burn"
BEFORE, AFTER = 40, 20


def intake_text() -> Column:
    return record_text(*FIELDS)


def query_text() -> Column:
    """The search text: fields that have something, without allergies and medications."""
    return F.concat_ws(" ", *(F.nullif(F.col(f), F.lit("")) for f in QUERY_FIELDS))


def is_pediatric(age: Column, text: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(age, F.lit(""))))
    number = lambda units: F.nullif(F.regexp_extract(low, rf"\b(\d{{1,3}})\s*(?:{units})\b", 1), F.lit("")).cast("int")
    months, short, years = number("mo|mos|month|months"), number("d|day|days|w|wk|wks|week|weeks"), number("y|yr|yrs|year|years")
    bare = F.nullif(F.regexp_extract(low, r"^\s*(\d{1,2})\s*$", 1), F.lit("")).cast("int")
    young = F.coalesce(years < 18, F.lit(False)) | F.coalesce(bare < 18, F.lit(False)) | text.rlike(CHILD)
    return F.when(months.isNotNull(), months < 216).when(short.isNotNull(), F.lit(True)).otherwise(young)


def is_pregnant(status: Column, text: Column) -> Column:
    low = F.replace(F.trim(F.lower(F.coalesce(status, F.lit("")))), F.lit("_"), F.lit(" "))
    denied = low.isin(*NOT_PREGNANT) | low.rlike(STATUS_DENIES)
    return F.when(denied, F.lit(False)).when(low.rlike(PREGNANT), F.lit(True)).when(text.rlike(DENIES_PREGNANCY), F.lit(False)).otherwise(text.rlike(PREGNANT))


@F.pandas_udf(T.BooleanType())
def mentions_fever(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether some mention of fever has no negation in the characters around it; the windows overlap, so offsets are needed."""

    def one(text: str | None) -> bool:
        text = text or ""
        return any(not NO_FEVER.search(text[max(0, m.start() - BEFORE) : m.end() + AFTER]) for m in FEVER.finditer(text))

    for batch in texts:
        yield batch.map(one).astype(bool)


def evaluate(df: DataFrame, strict: bool = True) -> DataFrame:
    """df with `fired` (the rules that fire, in order) and `floor`.

    strict: a record that is not confirmed fails the job; otherwise it fires nothing.
    """
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False))
    if strict:
        df = df.withColumn("_ok", F.assert_true(confirmed, F.lit("rules need a confirmed record"))).where(F.col("_ok").isNull()).drop("_ok")
    text = F.col("_text")
    rows = df.withColumn("_text", intake_text())
    rows = rows.withColumns({"_mention": mentions_fever(text), "_chest": first_unnegated(CUES["red_flag_chest_pain"])(text)})
    rows = rows.withColumns({"_fever": text.rlike(MEASURED_FEVER) | F.col("_mention"), "_pregnant": is_pregnant(F.col("pregnancy_status"), text), "_child": is_pediatric(F.col("patient_age"), text)})
    fever = F.when(F.col("_fever"), F.lit("fever"))
    cue = {k: first_match(text, v) for k, v in CUES.items()}
    evidence = {
        "AMS-001": cue["AMS-001"],
        "RESP-001": cue["RESP-001"],
        "PREG-001": F.when(F.col("_pregnant"), F.coalesce(cue["PREG-001"], fever)),
        "red_flag_chest_pain": F.col("_chest"),
        "STROKE-001": cue["STROKE-001"],
        "PED-DEHYD-001": F.when(F.col("_child"), cue["PED-DEHYD-001"]),
        "FEVER-001": F.when(F.col("_fever"), F.coalesce(cue["FEVER-001"], F.when(F.col("_pregnant") | text.rlike(r"\binfant\b"), F.lit("pregnancy/infant fever context")))),
        "WOUND-001": F.when(text.rlike(WOUND), F.coalesce(cue["WOUND-001"], fever)),
    }

    def one(ordinal: int, rule_id: str, label: str, level: str, card: str) -> Column:
        found = evidence[rule_id]
        severity = F.lit(level)
        if rule_id == "PED-DEHYD-001":
            severity = F.when(found.rlike(r"\bletharg(?:ic|y)|difficult to arouse\b"), F.lit("emergency")).otherwise(severity)
        parts = (F.lit(rule_id).alias("rule_id"), F.lit(label).alias("label"), severity.alias("severity"), found.alias("evidence"), F.lit(card).alias("card_id"), F.lit(ordinal).alias("check_ordinal"))
        return F.when(confirmed & found.isNotNull(), F.struct(*parts))

    rows = rows.withColumn("fired", compact_issues(*(one(i, *r) for i, r in enumerate(TABLE))))
    return rows.withColumn("floor", floor(F.col("fired"))).drop("_text", "_mention", "_chest", "_fever", "_pregnant", "_child")


def fact_ledger(df: DataFrame, key: str) -> DataFrame:
    """key, bucket (present, absent_or_denied, unclear), field, value of each record's facts."""
    told = F.trim(F.coalesce("value", F.lit("")))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in sorted(FIELDS)))
    rows = df.where("confirmed").select(key, F.inline(fields)).withColumn("value", told).where("value <> ''")
    unclear = F.lower("value").isin("unknown", "pending", "not recorded", "not available", "unclear")
    plain = rows.select(key, F.when(unclear, "unclear").otherwise("present").alias("bucket"), "field", "value")
    denied = F.regexp_extract_all("value", F.lit(r"(?i)\b((?:no|denies|denied|without)\s+[^,.;]+)"), F.lit(1))
    shown = F.transform(denied, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    absent = rows.where(~unclear).select(key, F.lit("absent_or_denied").alias("bucket"), "field", F.explode(shown).alias("value"))
    unconfirmed = df.where(~F.coalesce(F.col("confirmed"), F.lit(False))).select(key, F.lit("unclear").alias("bucket"), F.lit("confirmed").alias("field"), F.lit("intake is not confirmed").alias("value"))
    return plain.unionByName(absent).unionByName(unconfirmed)
