"""DuckDB SQL for the registered queries, made from the same dictionaries."""

from __future__ import annotations

from sievework.functions.severity import LEVELS
from sievework.operators.redaction import SUBSTITUTIONS
from sievework.operators.screening import Rule
from sievework.plans import dims


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, *names: str) -> str:
    shown = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"(VALUES {shown}) AS v({', '.join(names)})"


def first_match(text: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, {q(p)}, 1)), '')" for p in patterns) + ")"


def rule(r: Rule, ordinal: int) -> str:
    gate = f" AND regexp_matches(lower(text), {q(r.gate)})" if r.gate else ""
    evidence = first_match("lower(text)", r.patterns)
    return f"SELECT doc_id, lang, {q(r.rule_id)} AS rule_id, {q(r.severity)} AS severity, {LEVELS.index(r.severity)} AS rank, {evidence} AS evidence, {q(r.card_id)} AS card_id, {ordinal} AS check_ordinal FROM documents WHERE {evidence} IS NOT NULL{gate}"


FIRED = "fired AS (" + " UNION ALL ".join(rule(r, i) for i, r in enumerate(dims.RULES)) + ")"
LEVEL = "[" + ", ".join(q(x) for x in LEVELS) + "]"
FLOORS = f"{FIRED}, floors AS (SELECT d.doc_id, d.lang, coalesce(max(rank), 0) AS rank, count(rule_id) AS n_fired, coalesce(bool_or(card_id = 'ABUSE-CARD'), false) AS abuse FROM documents d LEFT JOIN fired f ON f.doc_id = d.doc_id GROUP BY d.doc_id, d.lang)"
TERMS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1)"
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

EXTRA = f"queries AS (SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM {values(dims.EXTRA_QUERIES, 'item_id', 'text')})"


def term_scores(queries: str, title: str) -> str:
    """CTE term_scored(item_id, doc_id, score)."""
    count = lambda hay: f"(length({hay}) - length(replace({hay}, term, ''))) // length(term)"
    extra = f" + 4 * ({count(title)})" if title else ""
    return f"""
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM {queries}) GROUP BY ALL),
term_scored AS (SELECT * FROM (SELECT item_id, doc_id, CAST(sum(times * ({count('lower(text)')}{extra})) AS DOUBLE) AS score
  FROM documents, wanted WHERE contains(lower(text), term){f" OR contains({title}, term)" if title else ""} GROUP BY item_id, doc_id) WHERE score > 0)"""


def bm25(queries: str) -> str:
    """CTE bm25_top(item_id, doc_id, score, rank)."""
    return f"""
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM {queries}) GROUP BY ALL),
sizes AS (SELECT doc_id, len({WORDS}) AS size FROM documents),
posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
idfs AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM posts, stats GROUP BY term, n),
bm25_scored AS (SELECT item_id, p.doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score
  FROM asked JOIN posts p ON p.term = asked.term JOIN idfs ON idfs.term = p.term JOIN sizes s ON s.doc_id = p.doc_id, stats GROUP BY ALL),
bm25_top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25_scored QUALIFY rank <= 10)"""


SETS = f"""docs AS (SELECT doc_id, lang, list_sort(list_distinct({WORDS})) AS td FROM documents),
items AS (SELECT item_id, list_sort(list_distinct({WORDS})) AS ti FROM benchmark)"""
CONTAINED = f"{SETS}, pairs AS (SELECT doc_id, item_id, td, ti, len(list_intersect(td, ti)) AS common FROM docs, items WHERE len(ti) > 0)"
LABELLED = f"{FLOORS}, rows AS (SELECT d.*, quality, toxic, f.rank, f.n_fired, f.abuse FROM documents d JOIN floors f ON f.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"
CHECKED = f"""{LABELLED}, checked AS (SELECT doc_id, quality = 1 AS quality_ok, toxic = 0 AS clean, CASE WHEN quality IS NOT NULL THEN n_chars >= 500 END AS long_enough,
  CASE WHEN toxic = 1 THEN abuse END AS toxic_caught, CASE WHEN toxic = 1 THEN rank >= 2 END AS floor_met FROM rows)"""
CHECKS = ("quality_ok", "clean", "long_enough", "toxic_caught", "floor_met")
SPLIT = f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n,
  row_number() OVER (PARTITION BY lang, source ORDER BY sha256('{dims.SPLIT_SEED}:' || doc_id), doc_id) AS place FROM documents),
split AS (SELECT *, CASE WHEN n >= {dims.SPLIT_GROUP} AND place <= least(greatest(1, round_even(n * {dims.SPLIT_FRACTION}, 0)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM ranked)"""
QUOTA = f"""targets AS (SELECT * FROM {values(dims.QUOTAS, 'p_brand', 'target')}),
ranked AS (SELECT p_partkey, part.p_brand, p_size, coalesce(target, 0) AS target, row_number() OVER (PARTITION BY part.p_brand ORDER BY p_size DESC, p_partkey) AS place
  FROM part LEFT JOIN targets ON targets.p_brand = part.p_brand),
chosen AS (SELECT * FROM ranked WHERE place <= target)"""
SETS_BY_LANG = f"sets AS (SELECT doc_id, lang, list_sort(list_distinct({WORDS})) AS tokens FROM documents), classes AS (SELECT lang, tokens, min(doc_id) AS class_id, count(*) AS members FROM sets GROUP BY lang, tokens)"
AUDIT = f"""{LABELLED}, audited AS (SELECT doc_id, rank, list_filter([CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
  CASE WHEN n_fired > 0 THEN 'rule_fired' END, CASE WHEN len({WORDS}) < 50 THEN 'too_short' END, CASE WHEN len(regexp_extract_all(text, '[#$%&*]')) > 10 THEN 'symbols' END], lambda x: x IS NOT NULL) AS reasons FROM rows),
scored AS (SELECT *, 100 - 15 * len(reasons) - CASE WHEN rank >= 2 THEN 20 ELSE 0 END AS score FROM audited)"""


def nested_redaction() -> str:
    text = "text"
    for pattern, mark in SUBSTITUTIONS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(mark.replace('$1', chr(92) + '1'))}, 'g')"
    return text


def slot_case() -> str:
    at, parts = 0, []
    for name, weight in dims.SLOTS:
        at += weight
        parts.append(f"WHEN o_orderkey % {sum(w for _, w in dims.SLOTS)} < {at} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " END"


def claims() -> str:
    parts = []
    for gate in dims.GATES:
        if gate.name not in dims.PROVEN:
            safe = f" AND NOT regexp_matches(lower(line), {q(gate.safe)})" if gate.safe else ""
            parts.append(f"SELECT doc_id, line_no, {q(gate.name)} AS gate FROM lines WHERE regexp_matches(lower(line), {q(gate.claim)}){safe}")
    return " UNION ALL ".join(parts)


AGE = {
    "months": "(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:months|month|mos|mo)(?:[^a-z0-9]|$)",
    "short": "(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:days|day|d|weeks|week|wks|wk|w)(?:[^a-z0-9]|$)",
    "years": "(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:years|year|yrs|yr|y)(?:[^a-z0-9]|$)",
    "bare": "^([0-9]{1,2})$",
}
AGES = ", ".join(f"CAST(nullif(regexp_extract(trim(lower(age)), {q(p)}, 1), '') AS INTEGER) AS {n}" for n, p in AGE.items())

def segments(count: str) -> str:
    return f"(SELECT c_mktsegment AS class, row_number() OVER (ORDER BY c_mktsegment) AS ordinal, count(*) AS {count} FROM customer GROUP BY c_mktsegment)"


SQL: dict[str, str] = {
    "q01_rule_hits": f"WITH {FIRED} SELECT doc_id, rule_id, severity, check_ordinal FROM fired",
    "q02_rule_first_evidence": f"WITH {FIRED} SELECT doc_id, rule_id, evidence, card_id FROM fired",
    "q03_severity_floor": f"WITH {FLOORS} SELECT doc_id, {LEVEL}[rank + 1] AS floor FROM floors",
    "q04_floor_histogram": f"WITH {FLOORS} SELECT lang, {LEVEL}[rank + 1] AS floor, count(*) AS n FROM floors GROUP BY ALL",
    "q05_forbidden_phrase_scan": " UNION ALL ".join(
        f"SELECT doc_id, {i} AS pattern, {first_match('lower(text)', (p,))} AS found FROM documents WHERE {first_match('lower(text)', (p,))} IS NOT NULL" for i, p in enumerate(dims.FORBIDDEN)
    ),
    "q06_clause_negation": "WITH c AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.;!?\\n]')) AS clause FROM documents), "
    f"k AS (SELECT * FROM {values([(c,) for c in dims.CUES], 'cue')}) "
    "SELECT doc_id, cue, count(*) AS hits, count(*) FILTER (WHERE regexp_matches(split_part(clause, cue, 1), '(?:^|[^a-z0-9])(?:"
    + "|".join(dims.MARKERS)
    + ")(?:[^a-z0-9]|$)')) AS negated FROM c, k WHERE trim(clause) <> '' AND contains(clause, cue) GROUP BY doc_id, cue",
    "q07_age_parse": f"WITH p AS (SELECT id, {AGES} FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 300 AS VARCHAR) || ' ' || list_extract({list(dims.AGE_UNITS)}, CAST(o_orderkey % {len(dims.AGE_UNITS)} + 1 AS INTEGER)) AS age FROM orders)), y AS (SELECT id, coalesce(months // 12, CASE WHEN short IS NOT NULL THEN 0 END, years, bare) AS age_years FROM p) "
    "SELECT id, age_years, coalesce(age_years < 18, false) AS is_minor FROM y",
    "q08_generic_line_ratio": "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), "
    "g AS (SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: len(regexp_extract_all(lower(x), '[a-z0-9]+')) <= 3)) AS generic FROM l) "
    "SELECT doc_id, lines, generic, generic >= greatest(3, lines // 2) AS dominated FROM g",
    "q09_query_tokens": f"WITH t AS (SELECT item_id, {TERMS} AS t FROM benchmark) SELECT item_id, generate_subscripts(t, 1) - 1 AS ordinal, unnest(t) AS term FROM t",
    "q10_term_score_topk": f"WITH {term_scores('benchmark', 'source')} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM term_scored QUALIFY rank <= 10",
    "q11_bm25_topk": f"WITH {bm25('benchmark')} SELECT item_id, doc_id, score, rank FROM bm25_top",
    "q12_retrieval_fallback": f"""WITH {EXTRA}, {bm25('queries')}, {term_scores('queries', '')},
      subs AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM term_scored QUALIFY rank <= 10),
      merged AS (SELECT item_id, 'bm25' AS source FROM bm25_top UNION ALL SELECT item_id, 'substring' FROM subs WHERE item_id NOT IN (SELECT item_id FROM bm25_top))
      SELECT queries.item_id, count(source) AS n, CASE count(DISTINCT source) WHEN 0 THEN 'none' WHEN 1 THEN min(source) ELSE 'mixed' END AS "primary" FROM queries LEFT JOIN merged ON merged.item_id = queries.item_id GROUP BY queries.item_id""",
    "q13_forced_then_ranked": f"""WITH {bm25('benchmark')}, m AS (
      SELECT item_id, doc_id, 1 AS grp, rank AS place, score FROM bm25_top UNION ALL SELECT item_id, item_id, 0, 0, NULL FROM benchmark UNION ALL SELECT item_id, item_id + 1, 0, 1, NULL FROM benchmark),
      u AS (SELECT item_id, doc_id, min(grp * 1000 + place) AS spot, coalesce(max(score), 999.0) AS score FROM m GROUP BY item_id, doc_id)
      SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY spot, doc_id) AS position, score FROM u QUALIFY position <= 6""",
    "q14_provenance_counts": "SELECT event_type AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY event_type",
    "q15_provenance_by_field": "SELECT user_id % 8 AS field, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS {c}" for c in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY user_id % 8",
    "q16_eval_counters": f"WITH {LABELLED} SELECT count(*) AS n, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, "
    "count(*) FILTER (WHERE toxic = 1 AND n_fired > 0) AS caught, count(*) FILTER (WHERE rank >= 2) AS urgent FROM rows",
    "q17_three_valued_checks": f"WITH {CHECKED} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER (WHERE {c}) AS success, count(*) FILTER (WHERE NOT {c}) AS failure, count(*) FILTER (WHERE {c} IS NULL) AS not_applicable FROM checked" for c in CHECKS),
    "q18_all_checks_flag": f"WITH {CHECKED}, l AS (SELECT doc_id, list_filter([{', '.join(CHECKS)}], lambda x: x IS NOT NULL) AS v FROM checked) "
    "SELECT doc_id, CASE WHEN len(v) = 0 THEN NULL ELSE list_bool_and(v) END AS all_passed FROM l",
    "q19_cue_coverage": f"WITH {CONTAINED} SELECT doc_id, item_id, len(ti) - common AS n_missing FROM pairs WHERE common / len(ti) >= 0.5",
    "q20_missing_cue_counts": f"WITH {CONTAINED}, x AS (SELECT unnest(list_filter(ti, lambda t: NOT list_contains(td, t))) AS token FROM pairs WHERE common / len(ti) >= 0.5) SELECT token, count(*) AS n FROM x GROUP BY token",
    "q21_latency_summary": "SELECT event_type, count(value) AS n, round(min(value), 3) AS min, round(CAST(avg(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max FROM events GROUP BY event_type",
    "q22_error_marker_scan": f"SELECT marker, bool_or(contains(lower(text), marker)) AS seen, count(*) FILTER (WHERE contains(lower(text), marker)) AS n_affected, min(doc_id) FILTER (WHERE contains(lower(text), marker)) AS first_affected FROM documents, {values([(m,) for m in dims.ERRORS], 'marker')} GROUP BY marker",
    "q23_spec_join": "SELECT l_returnflag, count(o_orderkey) AS matched, count(*) - count(o_orderkey) AS unmatched FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY l_returnflag",
    "q24_orphans_both_ways": "WITH a AS (SELECT DISTINCT o_orderkey AS key FROM orders), b AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_quantity > 10), u AS (SELECT 'left' AS side, key FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'right', key FROM b WHERE key NOT IN (SELECT key FROM a)) SELECT side, count(*) AS n, min(key) AS first_key FROM u GROUP BY side",
    "q25_semi_needed": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_orderstatus",
    "q26_last_writer_wins": "WITH u AS (SELECT c_custkey AS key, c_name AS name, 0 AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) SELECT key, name, source FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY source DESC) = 1",
    "q27_duplicate_ids": "SELECT sha256(text) AS content, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q28_strided_shards": "SELECT CAST(o_orderkey % 7 AS INTEGER) AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "q29_stratified_split": f"WITH {SPLIT} SELECT doc_id, split FROM split",
    "q30_split_manifest": f"WITH {SPLIT} SELECT lang, source, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation FROM split GROUP BY lang, source",
    "q31_quota_select": f"WITH {QUOTA} SELECT p_partkey, p_brand, place FROM chosen",
    "q32_quota_fill_and_shortage": f"WITH {QUOTA} SELECT t.p_brand, t.target, count(c.p_partkey) AS selected, greatest(t.target - count(c.p_partkey), 0) AS shortage FROM targets t LEFT JOIN chosen c ON c.p_brand = t.p_brand GROUP BY t.p_brand, t.target",
    "q32_quota_fill": f"WITH {QUOTA}, s AS (SELECT greatest((SELECT sum(target) FROM targets) - (SELECT count(*) FROM chosen), 0) AS short), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM ranked WHERE place > target) "
    "SELECT p_partkey, 'quota' AS reason FROM chosen UNION ALL SELECT p_partkey, 'fill' FROM r, s WHERE k <= short",
    "q33_weighted_schedule": f"WITH u AS (SELECT class, ordinal, target, unnest(range(target)) AS k FROM {segments('target')}) SELECT row_number() OVER (ORDER BY (target - k) / target::DOUBLE DESC, ordinal, k) AS position, class FROM u",
    "q33_apportioned_targets": f"WITH s AS (SELECT class, ordinal, weight * 97 / (sum(weight) OVER ())::DOUBLE AS share FROM {segments('weight')}), "
    "r AS (SELECT *, floor(share) AS f, 97 - sum(floor(share)) OVER () AS rest, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, ordinal) AS place FROM s) SELECT class, ordinal, CAST(f + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS target FROM r",
    "q34_cumulative_slot_class": f"SELECT {slot_case()} AS class, count(*) AS n FROM orders GROUP BY 1",
    "q35_exact_content_neighbor": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id > first_id",
    "q36_near_neighbor_jaccard": f"WITH {SETS_BY_LANG}, p AS (SELECT x.class_id AS a, y.class_id AS b, len(list_intersect(x.tokens, y.tokens)) AS c, len(x.tokens) + len(y.tokens) AS s "
    "FROM classes x JOIN classes y ON x.lang = y.lang AND x.class_id < y.class_id AND least(len(x.tokens), len(y.tokens)) >= 0.92 * greatest(len(x.tokens), len(y.tokens)) WHERE len(x.tokens) > 0) "
    "SELECT a, b, round(c / (s - c), 6) AS similarity FROM p WHERE c / (s - c) >= 0.92",
    "q36_token_set_classes": f"WITH {SETS_BY_LANG} SELECT doc_id, class_id, members FROM sets JOIN classes ON classes.lang = sets.lang AND classes.tokens = sets.tokens",
    "q37_first_exclusion_match": f"""WITH {CONTAINED}, m AS (
      SELECT d.doc_id, b.item_id, 'exact' AS reason FROM documents d JOIN benchmark b ON b.text = d.text UNION ALL
      SELECT doc_id, item_id, 'near' FROM pairs WHERE len(td) > 0 AND common / (len(td) + len(ti) - common) >= 0.5),
      g AS (SELECT doc_id, item_id, min(reason) AS reason FROM m GROUP BY ALL) SELECT doc_id, item_id, reason FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY item_id) = 1""",
    "q38_contamination_containment": f"WITH {CONTAINED} SELECT doc_id, item_id, round(common / len(ti), 6) AS containment FROM pairs WHERE common / len(ti) >= 0.9",
    "q39_precedence_merge": "SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN length(b.text) WHEN l.doc_id IS NOT NULL AND toxic = 0 THEN quality ELSE n_chars END AS value, "
    "CASE WHEN b.item_id IS NOT NULL THEN 'model_repaired' WHEN l.doc_id IS NOT NULL AND toxic = 0 THEN 'model_raw' ELSE 'deterministic_fallback' END AS provenance "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id",
    "q40_final_route": "SELECT CASE WHEN event_type = 'signup' THEN 'deterministic' WHEN event_type <> 'error' AND user_id % 3 <> 0 AND value <= 10 THEN 'model' WHEN event_type <> 'error' AND user_id % 3 = 0 AND value <= 10 THEN 'model_repaired' "
    "WHEN event_type <> 'error' AND value > 10 THEN 'mixed' ELSE 'fallback' END AS route, count(*) AS n FROM events GROUP BY 1",
    "q41_best_candidate": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N') DESC, l_quantity DESC, l_linenumber, l_partkey) = 1",
    "q42_label_diff": f"""WITH {FLOORS}, a AS (SELECT d.doc_id, (n_chars >= 1000)::INTEGER AS quality, abuse::INTEGER AS toxic FROM documents d JOIN floors f ON f.doc_id = d.doc_id WHERE n_chars >= 300),
      j AS (SELECT l.quality AS bq, a.quality AS aq, l.toxic AS bt, a.toxic AS ta FROM labels l FULL JOIN a ON a.doc_id = l.doc_id),
      u AS (SELECT 'quality' AS label, bq::VARCHAR AS before, aq::VARCHAR AS after FROM j UNION ALL SELECT 'toxic', bt::VARCHAR, ta::VARCHAR FROM j)
      SELECT label, before, after, count(*) AS n FROM u WHERE before IS DISTINCT FROM after GROUP BY ALL""",
    "q43_set_differences": """WITH k AS (SELECT user_id, coalesce(list_distinct(list(event_type) FILTER (WHERE value < 3)), []) AS e, coalesce(list_distinct(list(event_type) FILTER (WHERE value > 30)), []) AS a FROM events GROUP BY user_id)
      SELECT user_id, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(a, x))), ',') AS missing, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(e, x))), ',') AS unexpected FROM k""",
    "q44_replay_audit_reasons": f"WITH {AUDIT}, r AS (SELECT unnest(reasons) AS reason FROM scored) SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "q44_replay_score_histogram": f"WITH {AUDIT} SELECT CAST(score AS INTEGER) AS score, len(reasons) = 0 AS accepted, count(*) AS n FROM scored GROUP BY ALL",
    "q45_chat_shape_contract": """WITH c AS (SELECT conv_id, list(role ORDER BY turn, role) AS r, bool_or(trim(coalesce(text, '')) = '') AS blank, bool_or(role NOT IN ('user', 'assistant', 'system')) AS odd FROM conversations GROUP BY conv_id),
      k AS (SELECT conv_id, len(r) AS n_turns, CASE WHEN odd THEN 'unknown_role' WHEN blank THEN 'blank_content' WHEN r[1] NOT IN ('user', 'system') THEN 'bad_first_role'
        WHEN len(list_filter(range(1, len(r)), lambda i: r[i] = r[i + 1])) > 0 THEN 'not_alternating' WHEN r[-1] <> 'assistant' THEN 'bad_last_role' ELSE '' END AS reason FROM c)
      SELECT conv_id, n_turns, reason = '' AS ok, reason FROM k""",
    "q46_role_filter_with_reasons": "SELECT CASE WHEN role = 'system' THEN 'system_role' WHEN length(text) < 60 THEN 'too_short' WHEN NOT regexp_matches(lower(text), '[a-z]') THEN 'no_letters' ELSE 'kept' END AS reason, count(*) AS n FROM conversations GROUP BY 1",
    "q47_redact_secrets": f"SELECT doc_id, sha256({nested_redaction()}) AS redacted_sha256, CAST({' + '.join(f'len(regexp_extract_all(text, {q(p)}))' for p, _ in SUBSTITUTIONS)} AS INTEGER) AS n_hits FROM documents",
    "q48_claim_line_scan": f"WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM s) {claims()}",
    "q49_gate_rollup": "WITH r AS (SELECT bool_and(length(text) > 0) AS a, bool_and(length(text) = n_chars) AS b, bool_and(coalesce(quality IS NOT NULL, false)) AS c, bool_and(coalesce(toxic, 0) = 0) AS d FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id) "
    "SELECT 'has_text' AS gate, a AS passed FROM r UNION ALL SELECT 'char_count', b FROM r UNION ALL SELECT 'labelled', c FROM r UNION ALL SELECT 'no_toxic', d FROM r",
    "q50_row_hash_manifest": "WITH h AS (SELECT source, doc_id, CAST(('0x' || substr(sha256(concat_ws('|', doc_id, lang, source, n_chars, text)), 1, 15))::BIGINT AS HUGEINT) AS h FROM documents) SELECT source, count(*) AS n, CAST(sum(h) AS VARCHAR) AS content_sum, min(doc_id) AS first_key FROM h GROUP BY source",
}
