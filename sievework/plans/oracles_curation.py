"""DuckDB SQL for the queries of curation."""

from __future__ import annotations

from sievework.operators import output_policies, replay
from sievework.plans.oracles import q
from sievework.plans.queries_curation import ASKED, LINES, OBSERVED, SAID

LIST = "[" + ", ".join(map(q, OBSERVED)) + "]"
FLAT = "trim(regexp_replace(translate(lower(x), '-_', '  '), '\\s+', ' ', 'g'))"


def named(prefix: str, phrases: tuple[str, ...], test: str) -> str:
    """A list of the reasons of the phrases that an item holds, or null for each that none does."""
    return ", ".join(f"CASE WHEN len(list_filter(items, lambda x: {test.format(p=q(p))})) > 0 THEN {q(prefix + ':' + p.replace(' ', '_'))} END" for p in phrases)


REPLAY = f"""
a AS (SELECT doc_id AS d, text, {LIST} AS p FROM documents),
b AS (SELECT d, list_concat([p[d % {len(OBSERVED)} + 1]], CASE WHEN d % 5 = 0 THEN ['a', 'b', 'c'] ELSE [] END) AS missing, [p[(d // 12) % {len(OBSERVED)} + 1]] AS other,
             lower(substr(text, 1, 20) || CASE WHEN d % 13 = 0 THEN ' Teacher' WHEN d % 17 = 0 THEN '<think' ELSE '' END) AS note FROM a),
c AS (SELECT d, note, missing, CASE WHEN d % 2 = 0 THEN missing ELSE other END AS following FROM b),
e AS (SELECT d, note, missing, following, list_transform(list_concat(missing, following), lambda x: {FLAT}) AS items,
             CASE WHEN d % 3 = 0 THEN 'required_observation_id_selection' WHEN d % 3 = 1 THEN 'radio_handoff' ELSE 'missing' END AS category,
             CASE WHEN d % 3 = 0 AND d % 29 <> 0 THEN 'navigator_full' ELSE 'focused_repair' END AS task_type FROM c),
f AS (SELECT *, list_filter([
        CASE WHEN d % 11 = 0 THEN 'validator_failed' END, CASE WHEN d % 19 = 0 THEN 'expected_labels_failed' END,
        CASE WHEN contains(note, 'teacher') THEN 'teacher_artifact' END, CASE WHEN regexp_matches(note, '</?think') THEN 'visible_reasoning_tag' END,
        CASE WHEN len(missing) > 3 AND missing = following THEN 'duplicate_long_missing_and_next_observations' END,
        {named("harness_metadata_observation", replay.HARNESS_PHRASES, "contains(x, translate({p}, '-_', '  '))")},
        {named("generic_observation_phrase", replay.GENERIC_PHRASES, "x = {p}")},
        {named("unsafe_observation_fragment", replay.UNSAFE_FRAGMENTS, "contains(x, {p})")},
        CASE WHEN task_type = 'navigator_full' AND d % 6 <> 0 THEN 'observation_focused_row_missing_selected_required_observation_ids' END,
        CASE WHEN d % 12 = 0 THEN 'selected_required_observation_ids_missing_required' END], lambda r: r IS NOT NULL) AS found FROM e),
g AS (SELECT *, CASE WHEN category = 'radio_handoff' THEN 72 ELSE 20 END - CASE WHEN d % 9 = 0 THEN 20 ELSE 0 END + CASE WHEN d % 6 = 0 THEN 10 ELSE 0 END
             + CASE WHEN task_type = 'focused_repair' THEN 15 ELSE 0 END + CASE WHEN len(found) = 0 THEN 25 ELSE 0 END AS points FROM f),
h AS (SELECT *, list_concat(found, CASE WHEN d % 3 <> 0 THEN [] ELSE list_filter([CASE WHEN d % 10 = 0 THEN 'missing_target_source_card:FEVER-RED-FLAGS-v1' END,
        CASE WHEN d % 7 = 0 AND d % 4 <> 0 THEN 'missing_referral_sbar_source_card' END, CASE WHEN d % 6 = 3 THEN 'missing_safety_boundaries_source_card' END], lambda r: r IS NOT NULL) END) AS closed FROM g)"""

_SCOPES = (*replay.SCOPES, "unknown")


def broken(scope: str) -> str:
    """The sorted fields of q84's output with what the scope puts in, as one JSON text."""
    cards = "'[\"SAFETY-BOUNDARIES-v1\",\"C' || o_custkey || '\"]'"
    fields = {"protocol_urgency": "'\"urgent\"'", "source_cards": cards, "safety_boundary": "'\"' || o_orderpriority || '\"'"}
    fields |= {k: q(v) for k, v in replay.BROKEN.get(scope, {}).items()}
    if scope == "source_card_closure":
        fields["source_cards"] = "'[\"C' || o_custkey || '\"]'"
    if scope == "source_card_negative_correction":
        fields["source_cards"] = cards[:-2] + ",\"" + replay.DISTRACTORS[0] + "\"]'"
    for k in replay.REMOVED.get(scope, ()):
        fields.pop(k, None)
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(fields.items())) + " || '}'"


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


POLICY = f"""
WITH a AS (SELECT doc_id AS d, substr(text, 1, 30) || ' ' || ({listed(SAID)})[doc_id % {len(SAID)} + 1] AS said, {listed(ASKED)} AS g FROM documents),
b AS (SELECT *, [g[d % {len(ASKED)} + 1], g[(d + 1) % {len(ASKED)} + 1], g[(d + 2) % {len(ASKED)} + 1]] AS missing,
             CASE WHEN d % 5 = 0 THEN list_transform(range(1, 21), lambda k: 'x' || k) ELSE [g[(d + 3) % {len(ASKED)} + 1]] END AS following,
             CASE WHEN d % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN d % 9 = 0 THEN 2 ELSE 0 END AS thin FROM a),
c AS (SELECT *, list_concat(missing, following) AS items, lower(CAST(to_json(said) AS VARCHAR) || array_to_string(list_concat(missing, following), '","')) AS body FROM b),
e AS (SELECT *, len(list_filter(items, lambda x: {" OR ".join(f"regexp_matches(x, {q(p)})" for p in output_policies.GENERIC)})) AS dull FROM c)
SELECT d AS doc_id, issue FROM (
{" UNION ALL ".join(f"SELECT d, 'forbidden_lexical_tripwire:{n}' AS issue FROM e WHERE regexp_matches(body, {q(p)})" for n, p in output_policies.LEXICAL.items())}
UNION ALL SELECT d, 'negation_red_flags_must_be_empty' FROM e WHERE d % 3 = 0 AND d % 7 = 0
UNION ALL SELECT d, 'negation_candidate_pathway_must_be_safety_or_sbar' FROM e WHERE d % 3 = 0 AND d % 2 <> 0
UNION ALL SELECT d, 'negation_urgency_must_not_be_raised_by_denied_symptom' FROM e WHERE d % 3 = 0 AND d % 11 = 0
UNION ALL SELECT d, 'generic_output_dominated' FROM e WHERE dull >= greatest(3, len(items) // 2)
UNION ALL SELECT d, 'handoff_sbar_missing_required_parts' FROM e WHERE thin >= 2 OR thin > 0 AND d % 3 = 1
UNION ALL SELECT d, 'low_resource_unavailable_pulse_ox_requested' FROM e WHERE d % 13 = 0 AND list_has_any(items, ['repeat vitals'])
UNION ALL SELECT d, 'cognitive_load_next_observation_list_too_long' FROM e WHERE len(following) > {output_policies.MOST_NEXT})"""

SQL = {
    "q78_row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST, doc_id DESC) AS row_number FROM documents",
    "q79_zipped_positions": """
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal NULLS FIRST, c_custkey) AS position FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier)
SELECT coalesce(c.position, s.position) AS position, c_custkey, s_suppkey FROM c FULL JOIN s ON c.position = s.position""",
    "q80_numbered_cases": "WITH n AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS VARCHAR) AS n FROM part) SELECT p_partkey, 'case-' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS case_id FROM n",
    "q81_attempts_until": """
WITH w AS (SELECT count(*) // 2 AS wanted FROM customer),
o AS (SELECT o_orderkey AS i, o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_totalprice < 100000 THEN 'small' END AS reason, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders),
t AS (SELECT o.* FROM o, w WHERE nth <= 4 * wanted),
f AS (SELECT k, min(i) AS first FROM t WHERE reason IS NULL GROUP BY k),
e AS (SELECT coalesce((SELECT max(first) FROM (SELECT first, row_number() OVER (ORDER BY first) AS n FROM f), w WHERE n = wanted), (SELECT max(i) FROM t)) AS last),
m AS (SELECT t.*, first FROM t LEFT JOIN f ON f.k = t.k, e WHERE i <= last),
n AS (SELECT count(*) AS made FROM m)
SELECT 'accepted' AS outcome, count(*) AS n, CAST(sum(i) AS BIGINT) AS key_sum, any_value(made) AS made FROM m, n WHERE i = first GROUP BY 1
UNION ALL SELECT reason, count(*), 0, any_value(made) FROM m, n WHERE reason IS NOT NULL AND (first IS NULL OR i < first) GROUP BY reason""",
    "q82_replay_audit": f"""WITH {REPLAY}
SELECT d AS doc_id, category, task_type, CASE WHEN d % 29 = 0 THEN 'assistant_content_not_json' ELSE array_to_string(found, ',') END AS reasons,
       CAST(CASE WHEN d % 29 = 0 THEN 0 ELSE points END AS INTEGER) AS score, d % 29 <> 0 AND len(found) = 0 AS accepted FROM g""",
    "q83_replay_audit_with_closure": f"""WITH {REPLAY}
SELECT d AS doc_id, CASE WHEN d % 29 = 0 THEN 'assistant_content_not_json' ELSE array_to_string(closed, ',') END AS reasons,
       CAST(CASE WHEN d % 29 = 0 THEN 0 ELSE points + CASE WHEN d % 4 = 0 THEN 23 ELSE 0 END + CASE WHEN d % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN len(closed) = 0 THEN 25 ELSE 0 END END AS INTEGER) AS score FROM h""",
    "q84_corrupted_outputs": f"""
WITH s AS (SELECT *, ({[*_SCOPES]})[o_orderkey % {len(_SCOPES)} + 1] AS scope FROM orders)
SELECT o_orderkey, scope, CASE WHEN scope = 'unknown' OR scope = 'protocol_urgency' AND o_orderstatus = 'F' THEN NULL {" ".join(f"WHEN scope = {q(x)} THEN {broken(x)}" for x in replay.SCOPES)} END AS broken FROM s""",
    "q85_repair_assignment": """
WITH t AS (SELECT c_custkey AS position, c_mktsegment AS scope, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer),
n AS (SELECT scope, row_number() OVER (ORDER BY scope) - 1 AS j FROM (SELECT DISTINCT scope FROM t)),
e AS (SELECT scope, p_partkey, row_number() OVER (PARTITION BY scope ORDER BY p_partkey) AS k FROM part, n WHERE (p_partkey + j) % 3 = 0 AND p_partkey % 17 <> 0)
SELECT position, t.scope, p_partkey || '--repair-' || t.scope AS candidate FROM t LEFT JOIN e ON e.scope = t.scope AND e.k = t.k""",
    "q86_repair_rounds": f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS turn FROM lineitem),
t AS (SELECT l_orderkey AS id, turn, CASE l_partkey % 3 WHEN 0 THEN 'citations_and_pathways' WHEN 1 THEN 'handoff_note_sbar' ELSE 'protocol_urgency' END AS scope, l_suppkey % 5 AS kind,
             'CARD-' || l_suppkey % 3 || '-v1' AS must, 'CARD-' || CAST(l_quantity AS INTEGER) % 3 || '-v1' AS card, l_linestatus, l_returnflag FROM l WHERE turn <= {LINES}),
e AS (SELECT *, CASE WHEN kind = 0 THEN 'repair failed for ' || scope WHEN kind = 1 THEN 'repair for ' || scope || ' returned no object'
                     WHEN scope = 'citations_and_pathways' AND must <> card THEN 'repair omitted mandatory source cards: ' || must END AS event FROM t),
a AS (SELECT * FROM e WHERE turn <= 2),
c AS (SELECT id, CAST(count(*) AS INTEGER) AS scope_count FROM t GROUP BY id)
SELECT c.id, scope_count, scope_count > 2 AS capped, CAST(count(*) AS INTEGER) AS attempts, coalesce(string_agg(event, '; ' ORDER BY turn) FILTER (WHERE event IS NOT NULL), '') AS events,
       '"' || arg_max(l_linestatus, turn) FILTER (WHERE event IS NULL AND scope = 'protocol_urgency') || '"' AS protocol_urgency,
       '["' || arg_max(card, turn) FILTER (WHERE event IS NULL AND scope = 'citations_and_pathways') || '"]' AS source_cards,
       '"' || arg_max(l_returnflag, turn) FILTER (WHERE event IS NULL AND scope = 'handoff_note_sbar') || '"' AS handoff_note_sbar
FROM c JOIN a ON a.id = c.id JOIN orders ON o_orderkey = c.id GROUP BY c.id, scope_count""",
    "q87_settled_outputs": """
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS m, o_custkey % 2 = 0 AS fixed, o_orderpriority AS p, o_orderstatus <> 'P' AS has_note FROM orders),
r AS (SELECT *, CASE WHEN fixed AND NOT regexp_matches(p, '^[45]-') THEN 'repaired' WHEN m IN (0, 1) THEN 'patched by field' ELSE 'fallback' END AS event FROM o),
s AS (SELECT *, CASE WHEN event = 'repaired' THEN 'model_repaired' WHEN event = 'patched by field' AND m = 1 THEN 'model_raw' ELSE 'deterministic_fallback' END AS of_protocol_urgency,
             CASE WHEN event <> 'fallback' AND m = 0 THEN 'model_raw' ELSE 'deterministic_fallback' END AS of_source_cards,
             CASE WHEN event <> 'fallback' AND m = 0 AND has_note THEN 'model_raw' ELSE 'deterministic_fallback' END AS of_handoff_note_sbar FROM r)
SELECT id, '{"protocol_urgency":"' || CASE of_protocol_urgency WHEN 'model_repaired' THEN p WHEN 'model_raw' THEN 'raw' ELSE 'routine' END || '","source_cards":' || CASE of_source_cards WHEN 'model_raw' THEN '["R"]' ELSE '[]' END
       || ',"handoff_note_sbar":' || CASE of_handoff_note_sbar WHEN 'model_raw' THEN '"raw note"' ELSE 'null' END || '}' AS output, event, of_protocol_urgency, of_source_cards, of_handoff_note_sbar FROM s""",
    "q88_issue_summary": """
WITH d AS (SELECT doc_id, source, text, lang, len(string_split(text, ' ')) < 30 AS short FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d WHERE text <> '' AND NOT short),
i AS (SELECT doc_id, 0 AS place, 'empty' AS type, NULL AS detail FROM d WHERE text = '' UNION ALL SELECT doc_id, 0, 'short', NULL FROM d WHERE text <> '' AND short
      UNION ALL SELECT doc_id, 0, 'other_language', NULL FROM d WHERE text <> '' AND NOT short AND lang <> 'en' UNION ALL SELECT doc_id, place, 'license_line', substr(line, 1, 20) FROM l WHERE regexp_matches(lower(line), 'licen[sc]ed?'))
SELECT 'issue_types' AS kind, type AS name, count(*) AS n, NULL::BIGINT AS position FROM i GROUP BY type
UNION ALL SELECT 'categories', source, count(*), NULL FROM d GROUP BY source
UNION ALL SELECT 'sample', concat_ws(' ', type, detail), 1, doc_id FROM (SELECT * FROM i ORDER BY doc_id, place LIMIT 20)
UNION ALL SELECT 'issues', 'all', count(*), NULL FROM i""",
    "q89_policy_issues": POLICY,
}
