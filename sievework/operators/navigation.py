"""From screened records to outputs: observation targets, deterministic output, scaffold, hand-off note, scores.

The deterministic output is the default of the model column: any other source of JSON may take its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import severity
from sievework.functions.text import CUE_STOPWORDS, cue_tokens, normalize, words
from sievework.operators.intake import query_text
from sievework.operators.retrieval import clamp, top

SAFETY, HANDOFF = "SAFETY-BOUNDARIES-v1", "REFERRAL-SBAR-v1"
MOST_CARDS, LABELLED_CARDS = 6, 4
REASON = "Retrieved for the confirmed record and its rules."
BOUNDARY = "Navigation of local protocols only: no condition label, no treatment order, no routing without a person."


def observation_targets(cards: DataFrame) -> DataFrame:
    """One row for each required observation that is not blank: id, card_id, title, display_text, tokens, ordinal. Blank ones keep their number."""
    rows = cards.where(F.coalesce(F.trim("card_id"), F.lit("")) != "").select("card_id", "title", F.posexplode("required_observations").alias("_p", "_t"))
    rows = rows.withColumn("display_text", F.trim("_t")).where("display_text <> ''").withColumn("ordinal", F.col("_p") + 1)
    return rows.select(F.concat("card_id", F.lit("::required_observation::"), F.col("ordinal").cast("string")).alias("id"), "card_id", "title", "display_text", F.array_distinct(words(F.col("display_text"))).alias("cue_tokens"), "ordinal")


def card_body(columns: tuple[str, ...] = ("card_id", "title", "applies_to", "required_observations", "red_flags", "escalation_criteria", "local_actions", "forbidden_actions", "safety_boundary", "source_note")) -> Column:
    """All strings of a card, in its order."""
    return F.concat_ws(" ", *columns)


def retrieve(cases: DataFrame, cards: DataFrame, key: str, scored: DataFrame, limit: int = MOST_CARDS) -> DataFrame:
    """cases with `retrieved`: the best cards, in rank order, as structs of card_id and required_observations.

    scored has (key, card_id, score). A case without any search term gets the first cards, as a search for nothing would.
    """
    limit = clamp(limit)
    ranked = top(scored, key, "card_id", limit).select(key, "card_id", "rank")
    first = cards.select("card_id", F.row_number().over(Window.orderBy("card_id")).alias("rank")).where(F.col("rank") <= limit)
    blank = cases.where(F.size(words(query_text())) == 0).select(key).crossJoin(F.broadcast(first))
    chosen = ranked.unionByName(blank.select(*ranked.columns)).join(cards.select("card_id", "required_observations"), "card_id")
    lists = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "card_id", "required_observations"))).alias("_r"))
    slim = F.transform("_r", lambda x: F.struct(x["card_id"].alias("card_id"), x["required_observations"].alias("required_observations")))
    none = F.array().cast("array<struct<card_id:string,required_observations:array<string>>>")
    return cases.join(lists, key, "left").withColumn("retrieved", F.coalesce(slim, none)).drop("_r")


def handoff_note(urgency: Column, source_cards: Column) -> Column:
    """The four slots from confirmed facts."""
    said = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    labelled = lambda text, c: F.when(said(c).isNotNull(), F.concat(F.lit(text), said(c), F.lit(".")))
    labels = F.array_join(F.transform("fired", lambda r: r["label"]), "; ")
    flags = F.when(F.size("fired") > 0, F.concat(F.lit("Red flags: "), labels, F.lit(".")))
    rules = F.when(F.size("fired") > 0, F.concat(F.lit("Rules: "), F.array_join(F.transform("fired", lambda r: r["rule_id"]), "; "), F.lit(".")))
    background = F.concat_ws(" ", labelled("Setting: ", "setting"), labelled("Age: ", "patient_age"), labelled("Pregnancy status: ", "pregnancy_status"), rules)
    assessment = F.concat_ws(" ", labelled("Symptoms: ", "symptoms"), labelled("Vitals: ", "vitals"), flags)
    suffix = F.when(F.size(source_cards) > 0, F.concat(F.lit(" ("), F.array_join(F.slice(source_cards, 1, LABELLED_CARDS), ", "), F.lit(")"))).otherwise("")
    return F.struct(
        F.coalesce(said("chief_concern"), said("responder_note"), said("symptoms"), F.lit("Confirmed field concern")).alias("situation"),
        F.coalesce(F.nullif(background, F.lit("")), F.lit("No background in the confirmed intake.")).alias("background"),
        F.coalesce(F.nullif(assessment, F.lit("")), F.lit("No observations in the confirmed intake.")).alias("assessment_observations_only"),
        F.concat(F.lit("Request "), urgency, F.lit(" review per the cited local cards"), suffix, F.lit(".")).alias("handoff_request"),
    )


def cited_cards(current: Column | None = None) -> Column:
    """Cards of fired rules first, then what was cited of the retrieved ones; if none, the first three retrieved."""
    fired = F.array_distinct(F.transform("fired", lambda r: r["card_id"]))
    retrieved = F.transform("retrieved", lambda c: c["card_id"])
    named = fired if current is None else F.array_union(fired, F.array_intersect(current, F.array_union(retrieved, fired)))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(F.slice(retrieved, 1, 3)), 1, MOST_CARDS)


def deterministic_output(df: DataFrame, into: str = "output") -> DataFrame:
    """df with the output, as JSON, that needs no model."""
    safe = F.array_intersect(F.array(F.lit(SAFETY), F.lit(HANDOFF)), F.transform("retrieved", lambda c: c["card_id"]))
    cards = F.slice(F.array_union(cited_cards(), safe), 1, MOST_CARDS)
    rows = df.withColumn("_cards", cards)
    own = F.filter("_cards", lambda c: ~c.isin(SAFETY, HANDOFF))
    wanted = F.array_distinct(F.flatten(F.transform(F.filter("retrieved", lambda c: F.array_contains(own, c["card_id"])), lambda c: c["required_observations"])))
    fact = lambda label, c: F.struct(F.concat(F.lit(label), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("not recorded"))).alias("fact"), F.when(F.coalesce(F.col(c), F.lit("")) == "", "missing").otherwise("reported").alias("status"), F.lit("structured_field").alias("source"))
    made = F.struct(
        F.col("floor").alias("protocol_urgency"),
        F.col("fired").alias("red_flags"),
        F.array(fact("Concern: ", "chief_concern"), fact("Vitals: ", "vitals")).alias("intake_facts"),
        F.transform(own, lambda c: F.struct(c.alias("card_id"), F.lit(REASON).alias("reason_relevant"))).alias("candidate_protocol_pathways"),
        wanted.alias("missing_info_to_collect"),
        wanted.alias("next_observations_to_collect"),
        F.array(F.lit("Made without a model: a responder must verify every observation.")).alias("conflicts_or_uncertainties"),
        F.array(F.lit("Keep the fired rules in view."), F.lit("Collect what is missing before relying on a card.")).alias("responder_checklist"),
        F.array(F.lit("Do not assign a condition label."), F.lit("Do not downgrade red flags.")).alias("do_not_do"),
        F.col("_cards").alias("source_cards"),
        handoff_note(F.col("floor"), F.col("_cards")).alias("handoff_note_sbar"),
        F.lit("I will check the next observations on the card and call for help if danger signs stay.").alias("responder_plain_language_script"),
        F.lit(BOUNDARY).alias("safety_boundary"),
    )
    return rows.withColumn(into, F.to_json(made, {"ignoreNullFields": "false"})).drop("_cards")


def scaffold(df: DataFrame) -> DataFrame:
    """Columns of an output after deterministic patches, and `patched`: the fields that changed, in order.

    Needs urgency, source_cards, pathways (array of card ids), observations (array), floor, fired, retrieved.
    """
    level = F.when(severity.strictly_at_least(F.col("urgency"), F.col("floor")), F.col("urgency")).otherwise(F.col("floor"))
    rows = df.withColumn("_level", level).withColumn("_cards", cited_cards(F.col("source_cards")))
    fired = F.array_intersect(F.transform("fired", lambda r: r["card_id"]), F.col("_cards"))
    named = F.array_union(F.array_intersect(F.col("pathways"), F.col("_cards")), fired)
    own = F.filter("_cards", lambda c: ~c.isin(SAFETY, HANDOFF))
    rows = rows.withColumn("_paths", F.when(F.size(named) > 0, named).otherwise(F.slice(F.when(F.size(own) > 0, own).otherwise(F.col("_cards")), 1, 3)))
    wanted = F.flatten(F.transform(F.filter("retrieved", lambda c: F.array_contains(F.col("_paths"), c["card_id"]) & ~c["card_id"].isin(SAFETY, HANDOFF)), lambda c: c["required_observations"]))
    have, text = words(F.array_join("observations", " ")), normalize(F.array_join("observations", " "))
    lacking = F.filter(wanted, lambda o: (F.trim(o) != "") & (F.size(F.array_except(words(o), have)) > 0) & ~F.contains(text, normalize(o)))
    rows = rows.withColumn("_observations", F.concat("observations", F.array_distinct(lacking)))
    changes = [("protocol_urgency", "urgency", "_level"), ("source_cards", "source_cards", "_cards"), ("candidate_protocol_pathways", "pathways", "_paths"), ("missing_info_to_collect", "observations", "_observations")]
    patched = F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name)) for name, a, b in changes)))
    rows = rows.withColumn("patched", patched)
    for _, a, b in changes:
        rows = rows.withColumn(a, F.col(b)).drop(b)
    return rows


def render_note(note: Column, source_cards: Column, boundary: Column) -> Column:
    """The hand-off note as text; null if a slot is blank."""
    slots = [F.nullif(F.trim(note[s]), F.lit("")) for s in ("situation", "background", "assessment_observations_only", "handoff_request")]
    lines = [F.concat(F.lit(t), s) for t, s in zip(("S: ", "B: ", "A (observations only): ", "R: "), slots)]
    cards = F.when(F.size(source_cards) > 0, F.concat(F.lit("Source cards: "), F.array_join(source_cards, ", ")))
    whole = F.concat_ws("\n", *lines, cards, F.when(F.trim(boundary) != "", F.concat(F.lit("Safety boundary: "), F.trim(boundary))))
    good = slots[0].isNotNull()
    for s in slots[1:]:
        good = good & s.isNotNull()
    return F.when(good, whole)


def cue_present(cue: Column, text: Column, stopwords: tuple[str, ...] = CUE_STOPWORDS) -> Column:
    """All the cue's tokens are in the text, or its words stand there in a row."""
    tokens = cue_tokens(cue, stopwords)
    return ((F.size(tokens) > 0) & (F.size(F.array_except(tokens, cue_tokens(text, stopwords))) == 0)) | F.contains(normalize(text), normalize(cue))


def handoff_readiness(note: Column, source_cards: Column, red_flags: Column, unsupported: Column) -> Column:
    """struct of the parts of readiness, and ready: all of them."""
    slots = [F.trim(F.coalesce(note[s], F.lit(""))) for s in ("situation", "background", "assessment_observations_only", "handoff_request")]
    whole = F.concat_ws("\n", *slots)
    flat = normalize(whole)
    acts = r"(?i)\b(?:diagnos(?:e|is|ed)|prescrib(?:e|ed|ing)|administer|discharge|treat(?:ment)?|dose|dosing)\b"
    named = F.exists(red_flags, lambda r: F.contains(flat, normalize(r)))
    brief = F.length(whole) <= 900
    for s in slots:
        brief = brief & (F.length(s) <= 360)
    parts = {
        "situation_present": slots[0] != "",
        "background_present": slots[1] != "",
        "assessment_observation_only": (slots[2] != "") & ~slots[2].rlike(acts),
        "request_present": slots[3] != "",
        "source_card_cited": F.size(source_cards) > 0,
        "red_flags_visible": (F.size(red_flags) == 0) | flat.rlike("red flag|rule|deterministic") | named,
        "brevity_ok": brief,
    }
    ready = unsupported == 0
    for p in parts.values():
        ready = ready & p
    return F.struct(*(c.alias(n) for n, c in parts.items()), unsupported.alias("unsupported"), ready.alias("ready"))
