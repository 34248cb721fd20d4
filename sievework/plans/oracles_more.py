"""DuckDB SQL for the further queries."""

from __future__ import annotations

from sievework.functions.text import CUE_ALIASES, GROUNDING_STOPWORDS
from sievework.operators import labels, output_policies, redaction
from sievework.operators.intake import CHILD, DENIES_PREGNANCY, MEASURED_FEVER, NOT_PREGNANT, PREGNANT, STATUS_DENIES
from sievework.plans import dims
from sievework.plans.oracles import FLOORS, LABELLED, q, term_scores, values

GROUNDED = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(q(w) for w in GROUNDING_STOPWORDS)}))"
SINGULAR = "CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 's') AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END"
ALIAS = "CASE " + " ".join(f"WHEN w = {q(a)} THEN {q(b)}" for a, b in CUE_ALIASES.items()) + " WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"


def cues_of(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: {ALIAS}))"


def flat(text: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({text}), '[a-z0-9]+'), ' ')"


def number(pattern: str) -> str:
    return f"CAST(nullif(regexp_extract(trim(lower(age)), {q(pattern)}, 1), '') AS INTEGER)"


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1))"
LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"

def session_redaction() -> str:
    out = "text"
    for pattern, mark in redaction.SESSION_SECRETS:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{mark.replace('$', chr(92))}', 'g')"
    return out


def internal(text: str) -> str:
    any_of = lambda marks: "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"
    return f"({any_of(redaction.INTERNAL)} OR (contains({text}, '{redaction.ENVIRONMENT}') AND length({text}) > {redaction.LONG_CONTEXT}) OR (contains({text}, '{redaction.SESSION_PATH}') AND {any_of(redaction.SESSION_EVENTS)}))"


def families() -> str:
    called = lambda name: " OR ".join(f"contains(lower(text), '{w}')" for w in (name, *labels.FAMILIES[name][0]))
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS family FROM documents WHERE {called(n)}" for n in labels.FAMILIES)


def tripwires() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, 'forbidden_lexical_tripwire:{n}' AS issue FROM documents WHERE regexp_matches(lower(CAST(to_json(text) AS VARCHAR)), '{p}')" for n, p in output_policies.LEXICAL.items())


CHECKED = """WITH c AS (SELECT doc_id, doc_id % 6 IN (0, 1) AS flags, doc_id % 4 >= doc_id % 3 AS urgent, doc_id % 4 = doc_id % 3 AS cited, doc_id % 2 = 1 AS clean FROM documents)
SELECT doc_id, flags AS red_flags_match, urgent AS min_urgency_met, cited AS target_card_in_source_cards, true AS target_card_in_candidate_pathways, CAST(NULL AS BOOLEAN) AS handoff_readiness_passed,
       clean AS forbidden_behavior_absent, flags AND urgent AND cited AND clean AS all_expected_labels_passed FROM c"""

SQL = {
    "q51_severity_comparisons": f"""WITH {LABELLED}, e AS (SELECT *, CASE WHEN toxic = 1 THEN 'urgent' WHEN quality = 0 THEN 'unknown' END AS x FROM rows)
      SELECT doc_id, rank >= CASE WHEN x = 'urgent' THEN 2 ELSE 0 END AS at_least, CASE WHEN x IS NOT NULL THEN x = 'urgent' AND rank >= 2 END AS meets_expected, coalesce(x = 'urgent' AND rank >= 2, false) AS strictly FROM e""",
    "q52_snippets": """WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents), p AS (SELECT *, strpos(lower(t), 'idiot') AS at FROM t)
      SELECT doc_id, trim(CASE WHEN "at" > 0 THEN substr(t, CAST(greatest("at" - 40, 1) AS INTEGER), CAST("at" - greatest("at" - 40, 1) + 45 AS INTEGER)) ELSE substr(t, 1, 120) END) AS snippet FROM p""",
    "q53_compact_cells": """WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM conversations)
      SELECT conv_id, turn, replace(CASE WHEN length(f) > 60 THEN rtrim(substr(f, 1, 59)) || '…' ELSE f END, '|', '\\|') AS cell FROM f""",
    "q54_grounding_tokens": f"WITH g AS (SELECT doc_id, list_sort(list_distinct(list_transform({GROUNDED}, lambda w: {SINGULAR}))) AS g FROM documents) SELECT doc_id, len(g) AS n_tokens, sha256(array_to_string(g, ' ')) AS tokens_sha256 FROM g",
    "q55_cue_tokens": f"WITH c AS (SELECT item_id, unnest({cues_of('text')}) AS token FROM benchmark) SELECT token, count(*) AS n_items FROM c WHERE token NOT IN ('the', 'of', 'and') GROUP BY token",
    "q56_counter_keys": "SELECT substr(trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 1, 120) AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1",
    "q57_host_classes": f"""WITH h AS (SELECT {HOST} AS host FROM pages)
      SELECT CASE WHEN host = '' THEN 'none' WHEN host = 'localhost' OR regexp_matches(host, '^127\\.') THEN 'loopback' WHEN regexp_matches(host, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)[0-9.]+$') THEN 'private'
        WHEN regexp_matches(host, '^169\\.254\\.[0-9.]+$') THEN 'link_local' WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') THEN 'public_ip' WHEN ends_with(host, '.local') THEN 'mdns' ELSE 'dns' END AS class, host, count(*) AS n FROM h GROUP BY ALL""",
    "q58_open_json_fields": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS INTEGER)) AS with_k, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, count(*) FILTER (WHERE json_exists(props, '$.z')) AS with_z FROM events GROUP BY event_type",
    "q59_first_prompts": "SELECT conv_id, substr(arg_min(text, turn), 1, 1000) AS first_prompt FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "q60_positional_join": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM s) SELECT doc_id, line_no, role, length(line) AS chars FROM lines JOIN conversations ON conv_id = doc_id AND turn + 1 = line_no",
    "q61_distinct_ignoring_case": """WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
      d AS (SELECT item_id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS d FROM w) SELECT item_id, len(d) AS n, array_to_string(d[1:5], ' ') AS first_five FROM d""",
    "q62_priority_order": """WITH k AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM events GROUP BY user_id)
      SELECT user_id, array_to_string(list_concat(list_filter(['purchase', 'signup', 'none'], lambda p: list_contains(k, p)), list_filter(k, lambda x: x NOT IN ('purchase', 'signup', 'none'))), ',') AS kinds FROM k""",
    "q63_policy_issues": f"""WITH l AS (SELECT doc_id, {LINES} AS l FROM documents), g AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(lower(x), 'idiot|trash|licensed'))) AS g, list_transform(l, lambda x: {flat('x')}) AS n FROM l)
      SELECT doc_id, 'v3:generic' AS issue FROM g WHERE g >= greatest(3, len(l) // 2) UNION ALL SELECT doc_id, 'v3:too_many' FROM g WHERE len(l) > 10 UNION ALL SELECT doc_id, 'v6:same_lists' FROM g WHERE len(l) >= 2 AND n = list_reverse(n)""",
    "q64_rejection_tally": f"""WITH {LABELLED}, f AS (SELECT doc_id, arg_min(rule_id, check_ordinal) AS r FROM fired GROUP BY doc_id)
      SELECT CASE WHEN quality IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'toxic_yes' WHEN r IS NOT NULL THEN 'rule_' || trim(regexp_replace(lower(r), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'accepted' END AS key, count(*) AS n FROM rows LEFT JOIN f ON f.doc_id = rows.doc_id GROUP BY 1""",
    "q65_shard_rollup": "SELECT CAST(l_orderkey % 5 AS INTEGER) AS shard, count(*) AS attempts, max(l_linenumber) AS most_lines, bool_or(l_discount > 0.09) AS any_discounted, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1",
    "q66_run_summary": "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS slow, count(value) AS n_values, round(min(value), 3) AS min, round(CAST(avg(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max FROM events",
    "q67_provenance_maps": """WITH r AS (SELECT lang, n_chars, quality, toxic FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
      u AS (SELECT 'lang' AS field, CASE WHEN toxic = 1 THEN 'model_repaired' ELSE 'model_raw' END AS provenance, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS value FROM r UNION ALL
        SELECT 'quality', CASE WHEN quality IS NOT NULL AND n_chars > 1000 THEN 'model_raw' ELSE 'deterministic_fallback' END, 'x' FROM r)
      SELECT field, provenance, count(*) AS n, count(value) AS with_value FROM u GROUP BY field, provenance""",
    "q68_intake_predicates": f"""WITH v AS (SELECT *, lower(concat_ws(chr(10), age, status, note)) AS low, replace(trim(lower(status)), '_', ' ') AS s FROM {values(dims.INTAKES, 'id', 'age', 'status', 'note')}),
      n AS (SELECT *, {number('\\b([0-9]{1,3})\\s*(?:mo|mos|month|months)\\b')} AS mo, {number('\\b([0-9]{1,3})\\s*(?:d|day|days|w|wk|wks|week|weeks)\\b')} AS sh, {number('\\b([0-9]{1,3})\\s*(?:y|yr|yrs|year|years)\\b')} AS ye, {number('^\\s*([0-9]{1,2})\\s*$')} AS ba FROM v)
      SELECT id, CASE WHEN mo IS NOT NULL THEN mo < 216 WHEN sh IS NOT NULL THEN true ELSE coalesce(ye < 18, false) OR coalesce(ba < 18, false) OR regexp_matches(low, {q(CHILD)}) END AS pediatric,
        CASE WHEN s IN ({', '.join(q(x) for x in NOT_PREGNANT)}) OR regexp_matches(s, {q(STATUS_DENIES)}) THEN false WHEN regexp_matches(s, {q(PREGNANT)}) THEN true WHEN regexp_matches(low, {q(DENIES_PREGNANCY)}) THEN false ELSE regexp_matches(low, {q(PREGNANT)}) END AS pregnant,
        regexp_matches(low, {q(MEASURED_FEVER)}) AS measured_fever FROM n""",
    "q69_cue_presence": f"""WITH d AS (SELECT doc_id, {cues_of('text')} AS h, {flat('text')} AS f FROM documents), c AS (SELECT cue, {cues_of('cue')} AS t, {flat('cue')} AS n FROM {values([(c,) for c in dims.OBSERVATION_CUES], 'cue')})
      SELECT doc_id, cue FROM d, c WHERE (len(t) > 0 AND list_has_all(h, t)) OR contains(f, n)""",
    "q70_note_readiness": """WITH t AS (SELECT conv_id, list(trim(coalesce(text, '')) ORDER BY turn)[1:4] AS p FROM conversations GROUP BY conv_id),
      s AS (SELECT conv_id, [coalesce(p[1], ''), coalesce(p[2], ''), coalesce(p[3], ''), coalesce(p[4], '')] AS p FROM t),
      b AS (SELECT conv_id, p, length(array_to_string(p, chr(10))) <= 900 AND len(list_filter(p, lambda x: length(x) > 360)) = 0 AS brevity_ok FROM s)
      SELECT conv_id, p[1] <> '' AS situation_present, p[4] <> '' AS request_present, brevity_ok,
        brevity_ok AND p[1] <> '' AND p[2] <> '' AND p[3] <> '' AND p[4] <> '' AND NOT regexp_matches(p[3], '(?i)\\b(?:diagnos(?:e|is|ed)|prescrib(?:e|ed|ing)|administer|discharge|treat(?:ment)?|dose|dosing)\\b') AS ready FROM b""",
    "q71_gap_and_forced": f"""WITH {FLOORS}, c AS (SELECT doc_id, card_id AS card, min(check_ordinal) AS o FROM fired GROUP BY doc_id, card_id), m AS (
      SELECT doc_id, card, 0 AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS place, NULL AS score FROM c UNION ALL SELECT doc_id, 'TONE-CARD', 1, 1, 2.0 FROM documents UNION ALL SELECT doc_id, 'RIGHTS-CARD', 1, 2, 1.0 FROM documents),
      u AS (SELECT doc_id, card, min(grp * 1000 + place) AS spot, CAST(coalesce(max(score), 999.0) AS DOUBLE) AS score FROM m GROUP BY doc_id, card)
      SELECT doc_id, card, row_number() OVER (PARTITION BY doc_id ORDER BY spot, card) AS position, score FROM u QUALIFY position <= 3""",
    "q72_missing_specs": """WITH s AS (SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'new' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000)
      SELECT key IS NOT NULL AS found, priority, count(*) AS n FROM lineitem LEFT JOIN s ON key = l_orderkey GROUP BY ALL""",
    "q73_engine_mix": f"WITH v AS (SELECT * FROM {values(dims.EXTRA_QUERIES, 'item_id', 'text')}), {term_scores('v', '')} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM term_scored QUALIFY rank <= 10",
    "q74_session_secrets": f"SELECT doc_id, sha256({session_redaction()}) AS redacted_sha256, {internal('text')} AS internal FROM documents",
    "q75_behaviour_families": families(),
    "q76_policy_tripwires": tripwires(),
    "q77_label_checks": CHECKED,
}
