"""Recovery against a loop over records, row numbers and attempts against sorted lists."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import numbering, recovery, selection
from sievework.operators.validation import REQUIRED

CARDS = ["AA-v1", "BB-v2", "CC-v3"]
FAILURES = (
    "fired rule card AA-v1 is not cited in source_cards",
    "unknown source_cards: BB-v2",
    "protocol_urgency is missing or invalid",
    "handoff_note_sbar is missing: background",
    "missing required schema keys: safety_boundary, do_not_do",
    "red_flags must be a list",
    "forbidden clinical language: diagnose",
    "missing_info_to_collect does not reference required observations for AA-v1: pulse",
    "something else",
)
FIXED = {"citations_and_pathways": ["source_cards", "candidate_protocol_pathways"], "protocol_urgency": ["protocol_urgency"], "handoff_note_sbar": ["handoff_note_sbar"], "missing_observations": ["missing_info_to_collect", "next_observations_to_collect"]}


def scope_of(failure):
    if "handoff" in failure:
        return "handoff_note_sbar", FIXED["handoff_note_sbar"]
    if "does not reference" in failure:
        return "missing_observations", FIXED["missing_observations"]
    if failure.startswith(("fired", "unknown source")):
        return "citations_and_pathways", FIXED["citations_and_pathways"]
    if failure.startswith("forbidden"):
        return "forbidden_clinical_language", [f for f in REQUIRED if f not in ("protocol_urgency", "source_cards")]
    if "invalid" in failure:
        return "protocol_urgency", FIXED["protocol_urgency"]
    if failure.startswith("missing required"):
        return "schema", ["safety_boundary", "do_not_do"]
    if "must be" in failure:
        return "schema", [failure.split(" ")[0]]
    return "unclassified", list(REQUIRED)


def records():
    rng = random.Random(9)
    out, replies = [], {}
    for k in range(120):
        raw = {f: f"raw {f} {k}" for f in REQUIRED if rng.random() < 0.9} | {"missing_info_to_collect": [" a ", "b", ""], "extra": 1}
        fallback = {f: f"fall {f} {k}" for f in REQUIRED}
        failures = rng.sample(FAILURES, rng.randint(1, 6))
        good = rng.choice((0, 1, 2, 3))
        out.append((k, json.dumps(raw), json.dumps(fallback), failures, good))
        for scope in {scope_of(f)[0] for f in failures}:
            kind = rng.random()
            reply = {f: f"fix {scope} {f}" for f in rng.sample(REQUIRED, 9)} | {"missing_info_to_collect": ["b", "c "], "source_cards": rng.sample(CARDS, rng.randint(0, 3))}
            replies[k, scope] = None if kind < 0.1 else "[1]" if kind < 0.2 else "not json" if kind < 0.25 else json.dumps(reply)
    return out, replies


def valid(output, good):
    """Stands in for the validator: by the record, what must not come from where."""
    text = json.dumps(output)
    return {0: True, 1: "fix" not in text, 2: "raw" not in text, 3: False}[good]


def loop(row, replies, cap, merge_lists):
    k, raw, fallback, failures, good = row
    raw, fallback = json.loads(raw), json.loads(fallback)
    scopes = {}
    for f in failures:
        name, fields = scope_of(f)
        scopes.setdefault(name, ([], []))
        scopes[name][0].append(f)
        scopes[name][1].extend(fields)
    repaired, events, attempts = {}, [], 0
    for name, (own, fields) in list(scopes.items())[:cap]:
        attempts += 1
        text = replies[k, name]
        try:
            reply = json.loads(text or "null")
        except ValueError:
            reply = []
        if text is None:
            events.append(f"repair failed for {name}")
        elif not isinstance(reply, dict):
            events.append(f"repair for {name} returned no object")
        else:
            cards = [c for f in own for c in CARDS if c in f] if name == "citations_and_pathways" else []
            lacking = [c for c in cards if c not in reply["source_cards"]]
            if lacking:
                events.append("repair omitted mandatory source cards: " + ", ".join(lacking))
                continue
            for f in set(fields) & set(reply):
                if merge_lists and name == "missing_observations":
                    listed = lambda v: [x.strip() for x in (v if isinstance(v, list) else [v] if v else []) if x.strip()]
                    repaired[f] = list(dict.fromkeys(listed(raw.get(f)) + listed(reply[f])))
                else:
                    repaired[f] = reply[f]
    accepted = set() if "forbidden_clinical_language" in scopes else set(REQUIRED) - {f for _, fields in scopes.values() for f in fields}
    result = (fallback, dict.fromkeys(REQUIRED, "deterministic_fallback"), "fallback")
    for use, event in ((repaired, "repaired"), ({}, "patched by field")):
        if event == "repaired" and not repaired:
            continue
        source = {f: "model_repaired" if f in use else "model_raw" if f in raw and f in accepted else "deterministic_fallback" for f in REQUIRED}
        output = {f: use[f] if f in use else raw[f] if source[f] == "model_raw" else fallback[f] for f in REQUIRED}
        if valid(output, good) and set(source.values()) != {"deterministic_fallback"}:
            result = (output, source, event)
            break
    return attempts, len(scopes), events, repaired, *result


@pytest.mark.parametrize("cap,merge_lists", [(2, False), (None, True), (0, False)])
def test_recovery_like_a_loop(spark, cap, merge_lists):
    rows, replies = records()
    df = spark.createDataFrame(rows, "id long, output string, fallback string, failures array<string>, good int").repartition(3)
    told = spark.createDataFrame([(k, s, r) for (k, s), r in replies.items()], "id long, scope string, reply string")
    check = lambda d: d.withColumn("passed", F.when(F.col("good") == 0, True).when(F.col("good") == 1, ~F.col("output").contains("fix")).when(F.col("good") == 2, ~F.col("output").contains("raw")).otherwise(False)).withColumn("failures", F.array().cast("array<string>"))
    found = recovery.recover(df, "id", lambda turns: turns.join(told, ["id", "scope"]), check, cap, merge_lists).collect()
    assert len(found) == len(rows)
    seen = Counter()
    for r in found:
        attempts, scopes, events, repaired, output, source, event = loop(rows[r.id], replies, cap, merge_lists)
        assert (r.attempts, r.scope_count, r.events, r.event, r.capped) == (attempts, scopes, events, event, cap is not None and scopes > cap)
        assert {f: json.loads(v) for f, v in r.repaired.items()} == repaired
        assert json.loads(r.output) == output and r.provenance == source
        seen[event] += 1
    assert set(seen) >= {"fallback", "patched by field"} and (cap == 0 or seen["repaired"] > 5)


def test_valid_records_are_asked_no_more(spark):
    rows, replies = records()
    df = spark.createDataFrame([r[:4] for r in rows], "id long, output string, fallback string, failures array<string>").cache()
    asked = []

    def respond(turns):
        asked.append(turns.count())
        return turns.withColumn("reply", F.lit('{"protocol_urgency": "x", "source_cards": ["AA-v1", "BB-v2"]}'))

    check = lambda d: d.withColumn("passed", F.map_contains_key("repaired", F.lit("protocol_urgency")))
    found = recovery.repair_rounds(df, recovery.plan_turns(df, "id"), "id", respond, None, check=check).collect()
    assert asked == sorted(asked, reverse=True) and asked[-1] < asked[0]
    for r in found:
        names = list(dict.fromkeys(scope_of(f)[0] for f in rows[r.id][3]))
        stop = next((k for k, n in enumerate(names, 1) if n in ("protocol_urgency", "unclassified")), len(names))
        assert r.attempts == stop


def test_handoff_round(spark):
    rows = [(1, "good", '{"handoff_note_sbar":{"situation":"s"}}'), (2, "bad", None), (3, "bad", '{"handoff_note_sbar":"text"}'), (4, "bad", '{"handoff_note_sbar":{"situation":"good"}}'), (5, "bad", '{"handoff_note_sbar":{"situation":"worse"}}')]
    df = spark.createDataFrame([(k, json.dumps({"handoff_note_sbar": {"situation": s}, "do_not_do": ["x"]}), reply) for k, s, reply in rows], "id long, output string, told string")
    df = df.withColumns({"provenance": F.create_map(F.lit("handoff_note_sbar"), F.lit("model_raw"), F.lit("do_not_do"), F.lit("model_raw")), "failures": F.array().cast("array<string>"), "passed": F.lit(True)})
    ready = lambda d: d.withColumn("ready", F.col("output").contains("good")).withColumn("lacks", recovery.handoff_failures({"sbar_situation": F.lit(False), "handoff_brevity_ok": F.lit(True), "handoff_unsupported_fact_count": F.lit(2), "other": F.lit(False)}))
    check = lambda d: d.withColumns({"failures": F.array().cast("array<string>"), "passed": F.lit(True)})
    seen = []

    def respond(turns):
        seen.extend(turns.select("failures").first()[0])
        return turns.withColumn("reply", F.col("told"))

    found = {r.id: r for r in recovery.handoff_round(df, "id", respond, check, ready).collect()}
    assert {k: r.handoff_event for k, r in found.items()} == {1: None, 2: "backend failed", 3: "no note", 4: "repaired", 5: "not ready"}
    assert json.loads(found[4].output) == {"handoff_note_sbar": {"situation": "good"}, "do_not_do": ["x"]} and json.loads(found[5].output)["handoff_note_sbar"] == {"situation": "bad"}
    assert found[4].provenance == {"handoff_note_sbar": "model_repaired", "do_not_do": "model_raw"} and found[5].provenance["handoff_note_sbar"] == "model_raw"
    assert seen == ["handoff_note_sbar handoff_readiness_passed failed", "handoff_note_sbar unsupported fact count: 2", "handoff_note_sbar sbar_situation failed"]


def test_row_numbers_like_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40), k) for k in range(500)] + [(None, 900)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = {r.b: r.row_number for r in numbering.number_rows(df, F.desc("a"), "b").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {b: k for k, (_, b) in enumerate(order, 1)}
    assert numbering.number_rows(df.where("false"), "a").collect() == []
    ids = numbering.numbered_cases(df.limit(120), "case-", "a", "b", width=2)
    assert sorted(r.case_id for r in ids.collect()) == sorted(f"case-{k:02d}" for k in range(1, 121))
    assert all("Window" not in line for line in ids._jdf.queryExecution().executedPlan().toString().splitlines())


def test_zip_by_position(spark):
    left, right = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(20, "q"), (10, "p")], "j int, y string")
    assert sorted((r.position, r.x, r.y) for r in numbering.zip_rows(left, right, ["k"], ["j"], how="full").collect()) == [(1, "a", "p"), (2, "b", "q"), (3, "c", None)]


def test_nth_smallest(spark):
    rng = random.Random(8)
    values = [rng.choice((rng.randint(-(1 << 62), 1 << 62), rng.randint(-5, 5))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long").cache()
    for n in (1, 7, 200, 399, 400):
        assert numbering.nth_smallest(df, "v", n, bins=16) == sorted(values)[n - 1] == numbering.nth_smallest(df, "v", n)
    assert numbering.nth_smallest(df, "v", 401) is None and numbering.nth_smallest(df, "v", 0) is None


@pytest.mark.parametrize("count,most,resumed", [(20, None, False), (20, 25, False), (500, None, False), (20, 60, True), (0, None, False), (3, 60, True)])
def test_attempts_like_a_loop(spark, count, most, resumed):
    rng = random.Random(6)
    rows = [(3 * k, f"c{rng.randint(0, 60)}", rng.choice((None, "gap", "neighbour"))) for k in range(150)]
    done = [f"c{k}" for k in range(5)] if resumed else []
    accepted, kept, tally, made = set(done), [], Counter(), 0
    for index, key, reason in rows:
        if len(accepted) >= count or made >= (4 * count if most is None else most):
            break
        made += 1
        if key in accepted:
            continue
        if reason:
            tally[reason] += 1
        else:
            accepted.add(key)
            kept.append(index)
    df = spark.createDataFrame(rows, "i long, key string, reason string").repartition(4)
    found = selection.accept_until(df, "key", "i", "reason", count, most, spark.createDataFrame([(k,) for k in done], "key string") if resumed else None)
    assert sorted(r.i for r in found.accepted.collect()) == kept
    assert {r.reason: r.n for r in found.rejections.collect()} == tally
    assert (found.made, found.taken) == (made, len(accepted))
    assert found.accepted.columns == df.columns
