"""SQL of the queries in ``queries.py`` for DuckDB. Queries without an entry have none: their plans depend on Arrow code
or on a search."""

_SPACE = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"
_SOLID = r"[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"

_D = """d0 AS (
  SELECT case_no, id, state, questions, gold, _meta.group_key AS grp, _meta.link_keys AS link_keys, _meta.source AS source, _meta.source_id AS source_id, _meta.original_id AS original_id,
    _meta.source_split AS split, json_extract_string(questions, '$.decision.type') AS qtype, json_extract_string(questions, '$.decision.instructions') AS instructions,
    json_extract(questions, '$.decision.criteria') AS criteria, json_extract(gold, '$.decision.probabilities') AS probs
  FROM cases
), d1 AS (
  SELECT *, CASE qtype WHEN 'score' THEN list_transform(range(json_array_length(criteria)::BIGINT), lambda i: i::VARCHAR) WHEN 'noul' THEN ['false', 'true'] ELSE json_keys(criteria) END AS option_keys FROM d0
), d2 AS (
  SELECT *, CASE qtype WHEN 'score' THEN list_transform(option_keys, lambda k: json_extract_string(criteria, '$[' || k || ']')) ELSE list_transform(option_keys, lambda k: json_extract_string(criteria, '$."' || k || '"')) END AS option_desc,
    list_transform(option_keys, lambda k: json_extract(probs, '$."' || k || '"')::DOUBLE) AS p
  FROM d1
), d AS (
  SELECT *, list_position(p, list_max(p)) - 1 AS label, option_keys[list_position(p, list_max(p))] AS label_key,
    CASE qtype WHEN 'choice' THEN list_transform(option_keys, lambda k, i: CASE WHEN option_desc[i] IS NOT NULL AND option_desc[i] <> '' THEN k || ': ' || option_desc[i] ELSE k END)
      WHEN 'score' THEN list_transform(option_desc, lambda t, i: 'level ' || (i - 1)::VARCHAR || ': ' || t)
      ELSE ['false: ' || coalesce(nullif(option_desc[1], ''), 'no, the statement does not hold'), 'true: ' || coalesce(nullif(option_desc[2], ''), 'yes, the statement holds')] END AS texts
  FROM d2
)"""

_ROWS = (
    _D
    + f""", rows AS (
  SELECT case_no, sha256('[' || state || ',' || questions || ']') AS input_key, sha256(gold) AS gold_key, grp, coalesce(link_keys, []) AS link_keys, split, source, original_id, qtype, label_key,
    CASE split WHEN 'train' THEN 0 WHEN 'calibration' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 END AS priority
  FROM d WHERE grp IS NOT NULL
), uses AS (
  SELECT case_no, 'group:' || grp AS k FROM rows
  UNION SELECT case_no, 'link:' || k FROM (SELECT case_no, unnest(link_keys) AS k FROM rows) WHERE regexp_matches(k, '{_SOLID}')
), stars AS (
  SELECT DISTINCT case_no, min(case_no) OVER (PARTITION BY k) AS hub FROM uses
), steps AS (
  SELECT case_no AS a, hub AS b FROM stars UNION SELECT hub, case_no FROM stars
), found(case_no, c) USING KEY (case_no) AS (
  SELECT case_no, case_no FROM rows
  UNION
  SELECT s.b, min(f.c) FROM found f JOIN steps s ON s.a = f.case_no JOIN recurring.found r ON r.case_no = s.b WHERE f.c < r.c GROUP BY s.b
), members AS (
  SELECT DISTINCT r.grp, f.c FROM rows r JOIN found f USING (case_no)
), roots AS (
  SELECT grp, min(grp) OVER (PARTITION BY c) AS root, c FROM members
), names AS (
  SELECT c, 'component:' || sha256(to_json(list(grp ORDER BY grp))::VARCHAR) AS component, count(*) AS groups FROM members GROUP BY c
)"""
)


def _fraction(key: str, seed: int) -> str:
    return f"(('0x' || substr(sha256('[\"{seed}\",\"' || ({key}) || '\"]'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616)"


_U = _fraction("component", 7)
_MERGED = (
    _ROWS
    + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY input_key ORDER BY priority DESC, case_no) AS n, count(*) OVER (PARTITION BY input_key) AS copies,
    min(gold_key) OVER (PARTITION BY input_key) <> max(gold_key) OVER (PARTITION BY input_key) AS conflict
  FROM rows
), highest AS (
  SELECT m.c, max(r.priority) AS highest FROM rows r JOIN members m USING (grp) GROUP BY m.c
), fates AS (
  SELECT r.*, n.component, CASE WHEN conflict THEN 'conflict' WHEN r.priority < h.highest THEN 'cross_split' ELSE 'kept' END AS fate
  FROM ranked r JOIN members m USING (grp) JOIN highest h USING (c) JOIN names n USING (c) WHERE r.n = 1
), merged AS (
  SELECT * EXCLUDE (split), CASE WHEN fate <> 'kept' THEN NULL WHEN priority > 0 THEN split WHEN {_U} < 0.05 THEN 'calibration' WHEN {_U} < 0.05 + 0.1 THEN 'validation' WHEN {_U} < 0.05 + 0.1 + 0.1 THEN 'test' ELSE 'train' END AS split
  FROM fates
)"""
)

_RAW = f"""r0 AS (
  SELECT *, CASE type WHEN 'score' THEN list_transform(range(json_array_length(criteria)::BIGINT), lambda i: i::VARCHAR) WHEN 'noul' THEN ['false', 'true'] ELSE json_keys(criteria) END AS ks FROM raw
), conv AS (
  SELECT raw_no, id AS source_id, source, type AS qtype, CASE WHEN list_contains(ks, label) THEN '{{"decision":{{"type":"' || type || '","probabilities":{{' || array_to_string(list_transform(ks, lambda k: to_json(k)::VARCHAR || ':' || CASE WHEN k = label THEN '1.0' ELSE '0.0' END), ',') || '}}}}}}' END AS gold,
    'raw_parent:' || sha256(to_json(trim(regexp_replace(grp, '{_SPACE}+', ' ', 'g')))::VARCHAR) AS group_key,
    CASE WHEN instruction IS NULL OR NOT regexp_matches(instruction, '{_SOLID}') THEN 'blank instructions' WHEN ks IS NULL OR len(ks) < 2 THEN 'no criteria'
      WHEN NOT coalesce(list_contains(ks, label), false) THEN 'label isn''t among the criteria'
      WHEN NOT (coalesce(regexp_matches(state.text, '{_SOLID}'), false) OR coalesce(regexp_matches(state.question, '{_SOLID}'), false)) THEN 'blank state' END AS reason
  FROM r0
)"""

_CHARS = "list_transform(string_split({0}, ''), lambda c: unicode(c) + 10)"
_ITEMS = """, t0 AS (
  SELECT *, 'x' AS _x, len(texts) AS n, list_transform(texts, lambda t: length(t) + 2) AS ol, length(qtype || ' question: ' || instructions) AS hl FROM d
), t1 AS (
  SELECT *, list_transform(ol, lambda x: least(x, 49)) AS cl, {head} - list_sum(list_transform(ol, lambda x: least(x, 49))) AS b0 FROM t0
), t2 AS (
  SELECT *, CASE WHEN b0 < 16 THEN list_transform(cl, lambda x: least(x, greatest(4, ({head} - 16) // n))) ELSE cl END AS fl FROM t1
), t3 AS (
  SELECT *, {head} - list_sum(fl) AS budget, list_concat([1], list_transform(string_split(qtype || ' question: ' || instructions, ''), lambda c: unicode(c) + 10), [2],
    flatten(list_transform(texts, lambda t: list_concat([3], list_transform(string_split(' ' || t, ''), lambda c: unicode(c) + 10)))), [2]) AS prefix,
    list_transform(ol, lambda x, i: hl + 2 + coalesce(list_sum(ol[1:i-1]), 0)) AS places, list_transform(string_split(state, ''), lambda c: unicode(c) + 10) AS body FROM t2
), items AS (
  SELECT *, greatest(0, {cap} - (hl + 3 + list_sum(fl)) - 1) AS room,
    CASE WHEN fl <> ol THEN 'option_text_truncated' WHEN hl > greatest(8, budget) THEN 'question_instruction_truncated' WHEN length(state) > greatest(0, {cap} - len(prefix) - 1) THEN 'state_truncated'
      WHEN length(state) = 0 OR greatest(0, {cap} - len(prefix) - 1) = 0 THEN 'empty_state_tokens' END AS reason FROM t3
)"""
_LENIENT = """, l0 AS (
  SELECT *, list_transform(texts, lambda t: least(length(t) + 2, 49)) AS cl, list_transform(string_split(qtype || ' question: ' || instructions, ''), lambda c: unicode(c) + 10) AS head FROM d
), l1 AS (
  SELECT *, 120 - list_sum(cl) AS budget FROM l0
), lenient AS (
  SELECT *, CASE WHEN budget < 16 THEN 'head too small for its options' END AS reason,
    list_concat([1], head[1:greatest(8, budget)], [2], flatten(list_transform(texts, lambda t: list_concat([3], list_transform(string_split(' ' || t, ''), lambda c: unicode(c) + 10))[1:49])), [2]) AS prompt,
    list_transform(string_split(state, ''), lambda c: unicode(c) + 10) AS body FROM l1
)"""

_P = """kinds AS (
  SELECT vec_id, label, ['choice', 'score', 'noul'][label % 3 + 1] AS qtype, embedding FROM embeddings
), pred AS (
  SELECT vec_id, qtype, list_transform(embedding[1:CASE WHEN qtype = 'noul' THEN 2 ELSE 4 END], lambda x: x::DOUBLE * 6) AS logits, CASE WHEN qtype = 'noul' THEN 2 ELSE 4 END AS k, label % CASE WHEN qtype = 'noul' THEN 2 ELSE 4 END AS place FROM kinds
), soft AS (
  SELECT *, list_transform(range(k), lambda i: CASE WHEN i = place THEN 0.7::DOUBLE ELSE 0.3::DOUBLE / (k - 1) END) AS target, list_transform(logits, lambda x: exp(x / {t} - list_max(logits) / {t})) AS e FROM pred
), scored0 AS (
  SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM soft
), scored AS (
  SELECT *, list_max(p) AS confidence, (list_position(p, list_max(p)) - 1 = list_position(target, list_max(target)) - 1)::INT AS correct,
    list_sum(list_transform(p, lambda x, i: target[i] * greatest(ln(greatest(x, 1e-12)), -9.21))) AS log_score FROM scored0
)"""

_EVENTS = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_JUDGED = "j AS (SELECT l_orderkey AS qid, l_partkey AS pid, least(floor(l_quantity / 13), 3)::INT AS grade FROM lineitem)"
_DOCS = "docs AS (SELECT doc_id, coalesce(length(text), 0) AS length FROM documents)"


def _plan(source: str, item: str) -> str:
    return f"""ranked AS (SELECT {item}, length, row_number() OVER (ORDER BY {_fraction(item + "::VARCHAR", 5)}, {item}) - 1 AS rank FROM {source}),
placed AS (SELECT {item}, length, rank // 1024 AS win, row_number() OVER (PARTITION BY rank // 1024 ORDER BY length, {item}) - 1 AS spot FROM ranked),
plan AS (SELECT {item}, length, win, (win * 64 + spot // 16)::BIGINT AS batch, (spot % 16)::INT AS place FROM placed)"""


_T = "CASE qtype WHEN 'choice' THEN 1.5 WHEN 'score' THEN 0.8 ELSE 1.0 END::DOUBLE"

SQL = {
    "raw_conversion": f"WITH {_RAW} SELECT raw_no, source_id, qtype, gold, group_key, reason FROM conv",
    "raw_rejections": f"WITH {_RAW} SELECT source, reason, count(*) AS n FROM conv WHERE reason IS NOT NULL GROUP BY ALL",
    "decision_rows": f"WITH {_D} SELECT case_no, 'decision' AS question_id, qtype, instructions, array_to_string(option_keys, '|') AS option_keys, label::INT AS label, label_key FROM d",
    "case_reasons": f"WITH {_D} SELECT qtype, CASE WHEN NOT regexp_matches(instructions, '{_SOLID}') THEN 'blank instructions' WHEN len(option_keys) < 2 AND qtype = 'choice' THEN 'choice needs two options' WHEN len(option_keys) < 2 AND qtype = 'score' THEN 'score needs two levels' WHEN abs(list_sum(p) - 1) > 1e-4 THEN 'no distribution' ELSE 'valid' END AS verdict, count(*) AS n FROM d GROUP BY ALL",
    "case_digests": "SELECT case_no, substr(sha256('[' || to_json(_meta.source_id)::VARCHAR || ',' || state || ',' || json_extract(questions, '$.decision')::VARCHAR || ']'), 1, 24) AS case_digest, sha256('[' || state || ',' || questions || ']') AS input_key FROM cases",
    "provenance": """SELECT c.case_no, coalesce(m.source_family, s.source_family) AS source_family, coalesce(m.task_family, s.task_family) AS task_family, coalesce(m.domain, s.domain) AS domain, coalesce(m.revision, s.revision) AS revision, coalesce(m.license, s.license) AS license,
  CASE WHEN s.name IS NULL THEN 'unknown source' WHEN clash <> '' THEN 'contradicts its source: ' || clash END AS reason
FROM (SELECT case_no, _meta AS m FROM cases) c LEFT JOIN sources s ON s.name = m.source,
LATERAL (SELECT concat_ws(',', CASE WHEN m.source_family <> s.source_family THEN 'source_family' END, CASE WHEN m.task_family <> s.task_family THEN 'task_family' END, CASE WHEN m.domain <> s.domain THEN 'domain' END, CASE WHEN m.revision <> s.revision THEN 'revision' END, CASE WHEN m.license <> s.license THEN 'license' END) AS clash)""",
    "option_texts": f"WITH {_D} SELECT case_no, array_to_string(texts, chr(10)) AS options FROM d",
    "targets": f"WITH {_D} SELECT case_no, CASE qtype WHEN 'choice' THEN 0 WHEN 'score' THEN 1 ELSE 2 END::INT AS kind_no, array_to_string(list_transform(p, lambda x: round(x / list_sum(p), 6)::VARCHAR), '|') AS target, label::INT AS label FROM d",
    "source_names": "SELECT regexp_replace(coalesce(nullif(_meta.source, ''), nullif(_meta.source_family, ''), nullif(_meta.source_split, ''), 'unknown'), '(_train|_validation|_val|_test|_dev)$', '') AS name, count(*) AS n FROM cases GROUP BY ALL",
    "group_keys_composed": f"SELECT doc_id, 'text:' || sha256(to_json(trim(regexp_replace(nfc_normalize(text), '{_SPACE}+', ' ', 'g')))::VARCHAR) AS group_key FROM documents WHERE regexp_matches(text, '{_SOLID}')",
    "hash_fractions": f"SELECT doc_id, u, CASE WHEN u < 0.05 THEN 'calibration' WHEN u < 0.05 + 0.1 THEN 'validation' WHEN u < 0.05 + 0.1 + 0.1 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, {_fraction('doc_id::VARCHAR', 7)} AS u FROM documents)",
    "hash_sample": f"SELECT event_id, user_id FROM events WHERE {_fraction('user_id::VARCHAR', 3)} < 0.3",
    "dedup_survivors": f"WITH RECURSIVE {_MERGED} SELECT input_key, case_no, copies, conflict FROM ranked WHERE n = 1",
    "contradictions": """SELECT doc_id, rater, differs FROM (
  SELECT doc_id, rater, min(reading_level) OVER (PARTITION BY doc_id) <> max(reading_level) OVER (PARTITION BY doc_id) AS torn, reading_level <> first_value(reading_level) OVER (PARTITION BY doc_id ORDER BY rater) AS differs
  FROM doc_grades WHERE reading_level IS NOT NULL) WHERE torn""",
    "connected_components": f"WITH RECURSIVE {_ROWS} SELECT grp, root FROM roots",
    "record_components": """WITH RECURSIVE stars AS (SELECT DISTINCT grp AS s, min(grp) OVER (PARTITION BY id) AS hub FROM raw WHERE grp IS NOT NULL AND id IS NOT NULL),
steps AS (SELECT s AS a, hub AS b FROM stars UNION SELECT hub, s FROM stars), found(s, c) USING KEY (s) AS (SELECT DISTINCT grp, grp FROM raw WHERE grp IS NOT NULL UNION SELECT t.b, min(f.c) FROM found f JOIN steps t ON t.a = f.s JOIN recurring.found r ON r.s = t.b WHERE f.c < r.c GROUP BY t.b)
SELECT s AS grp, c AS root FROM found""",
    "component_names": f"WITH RECURSIVE {_ROWS} SELECT component, groups FROM names",
    "leak_free_split": f"WITH RECURSIVE {_MERGED} SELECT case_no, component, copies, fate, split FROM merged",
    "unit_counts": f"WITH RECURSIVE {_MERGED}, units AS (SELECT source, 'converted' AS stage, split, original_id, grp FROM rows UNION ALL SELECT source, 'output', split, original_id, grp FROM merged WHERE fate = 'kept') SELECT source, stage, split, count(DISTINCT original_id) AS original_records, count(DISTINCT grp) AS groups, count(*) AS decisions FROM units GROUP BY ALL",
    "build_counters": f"""WITH RECURSIVE {_MERGED}, {_RAW}
SELECT 'converted' AS key, count(*) AS n FROM rows UNION ALL SELECT 'rejected:' || source || ':' || reason, count(*) FROM conv WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'duplicate_inputs', sum(copies - 1)::BIGINT FROM merged UNION ALL SELECT 'conflicting_inputs_excluded', count(*) FROM merged WHERE fate = 'conflict'
UNION ALL SELECT 'cross_split_group_rows_excluded', count(*) FROM merged WHERE fate = 'cross_split' UNION ALL SELECT 'connected_components', count(DISTINCT component) FROM merged
UNION ALL SELECT 'output:' || split || ':' || qtype, count(*) FROM merged WHERE fate = 'kept' GROUP BY 1 UNION ALL SELECT 'labels:' || split || ':' || source || ':' || qtype || ':' || label_key, count(*) FROM merged WHERE fate = 'kept' GROUP BY 1""",
    "group_leakage": f"SELECT grp, min(s) AS lowest, max(s) AS highest, count(DISTINCT s) AS splits FROM (SELECT grp, lower(regexp_replace(regexp_replace(split, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS s FROM groups WHERE regexp_matches(split, '{_SOLID}')) GROUP BY grp HAVING min(s) <> max(s)",
    "repeated_ids": "SELECT id, count(*) AS n, min(case_no) AS first_case FROM (SELECT id, case_no FROM cases) GROUP BY id HAVING count(*) > 1",
    "judged_pairs": f"WITH {_JUDGED} SELECT qid, pid, grade, o_orderpriority AS query, p_name AS passage FROM j JOIN orders ON o_orderkey = qid JOIN part ON p_partkey = pid",
    "ungraded_documents": "SELECT doc_id, kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_grades)",
    "referenced_orders": f"WITH {_JUDGED} SELECT o_orderkey AS qid, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT qid FROM j WHERE grade = 0)",
    "audited_lookup": "SELECT p_name, CASE WHEN p_name IS NULL THEN 'no such part' END AS reason, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_retailprice < 950) ON p_partkey = l_partkey GROUP BY ALL",
    "gold_membership": """WITH gold AS (SELECT p_partkey AS a, string_split(string_split(p_name, ' ')[1] || '##' || p_brand || '##' || p_type, '##') AS g FROM part),
words AS (SELECT DISTINCT p_partkey AS a, unnest([p_brand, p_type, 'Brand#1', 'red']) AS b FROM part), sold AS (SELECT l_partkey AS a, max((l_quantity > 49)::INT) AS label FROM lineitem GROUP BY 1)
SELECT label, member, member = label AS agrees, count(*) AS n FROM (SELECT label, list_contains(g, b)::INT AS member FROM words JOIN sold USING (a) JOIN gold USING (a)) GROUP BY ALL""",
    "zipped_lists": "SELECT coalesce(l.key, r.key) AS key, coalesce(l.place, r.place)::INT AS place, n_name, letter FROM (SELECT n_regionkey AS key, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, n_name FROM nation) l FULL JOIN (SELECT r_regionkey AS key, generate_subscripts(string_split(r_name, ''), 1) AS place, unnest(string_split(r_name, '')) AS letter FROM region) r ON l.key = r.key AND l.place = r.place",
    "zipped_slots": """WITH l AS (SELECT raw_no AS key, generate_subscripts(state.slots, 1)::INT AS place, unnest(list_transform(state.slots, lambda x: x.name)) AS slot FROM raw WHERE len(state.slots) > 0),
k AS (SELECT raw_no, list_sort(json_keys(criteria)) AS c FROM raw WHERE json_type(criteria) = 'OBJECT'), r AS (SELECT raw_no AS key, generate_subscripts(c, 1)::INT AS place, unnest(c) AS criterion FROM k)
SELECT coalesce(l.key, r.key) AS key, coalesce(l.place, r.place) AS place, slot, criterion FROM l FULL JOIN r ON l.key = r.key AND l.place = r.place""",
    "label_fan_out": "WITH u AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 40) AS labels FROM events GROUP BY 1), w AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label_name) SELECT label_name, count(*) FILTER (list_contains(labels, label_name)) AS positive, count(*) AS n FROM u CROSS JOIN w GROUP BY ALL",
    "candidate_groups": "SELECT l_orderkey, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS positives, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING candidates = 4 AND positives = 1 AND parts = 4",
    "label_sets": f"SELECT sha256(state.text) AS text_key, type, count(*) AS n, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS labels, count(DISTINCT label)::INT AS different FROM raw WHERE regexp_matches(state.text, '{_SOLID}') GROUP BY state.text, type HAVING count(*) > 1",
    "overlapping_documents": f"WITH k AS (SELECT doc_id, grp, lower(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))) AS t FROM documents WHERE regexp_matches(text, '{_SOLID}')) SELECT doc_id FROM k WHERE starts_with(grp, 'desk:') AND t IN (SELECT t FROM k WHERE NOT starts_with(grp, 'desk:'))",
    "dialogue_prefixes": f"SELECT event_id, md5(string_agg(event_type, chr(10)) {_EVENTS} ROWS UNBOUNDED PRECEDING)) AS prefix FROM events",
    "sessions": f"SELECT event_id, sum(far) {_EVENTS})::BIGINT AS session FROM (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) {_EVENTS}) > 21600000000)::INT, 1) AS far FROM events)",
    "continued_sessions": f"SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) {_EVENTS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS continues FROM events",
    "broken_runs": f"SELECT user_id, event_type, sum(c)::BIGINT AS runs FROM (SELECT *, coalesce((lag(event_type) {_EVENTS}) <> event_type)::INT, 1) AS c FROM events) GROUP BY 1, 2 HAVING sum(c) > 1",
    "label_blind_order": """SELECT place::INT AS place, count(*) AS n, sum(l_linenumber)::BIGINT AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('["' || l_partkey || '","' || l_linenumber || '","' || l_suppkey || '"]')) AS place FROM lineitem) GROUP BY 1""",
    "label_blind_places": """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('["' || l_partkey || '","' || l_linenumber || '","' || l_suppkey || '"]'))::INT AS place FROM lineitem""",
    "enumerated_slots": "SELECT raw_no, generate_subscripts(s, 1)::INT AS entry_no, unnest(s) AS slot FROM (SELECT raw_no, list_sort(list_distinct(list_transform(state.slots, lambda x: x.name))) AS s FROM raw WHERE len(state.slots) > 0)",
    "span_checks": "SELECT doc_id, (instr(text, '医生') - 1)::INT AS at, substring(text, instr(text, '医生'), 2) = '医生' AS holds, substring(text, instr(text, '医生') + 1, 2) = '医生' AS shifted FROM documents WHERE contains(text, '医生')",
    "picture_references": "SELECT raw_no FROM raw WHERE regexp_matches(state.text, '如图|下图|见图|化验单|拍片')",
    "answer_letters": r"SELECT raw_no, CASE WHEN regexp_matches(label, '^[A-Z](?:[A-Z]|[,，、\s]+[A-Z])*$') AND len(l) = len(list_distinct(l)) THEN array_to_string(l, '') END AS letters FROM (SELECT raw_no, label, regexp_extract_all(label, '[A-Z]') AS l FROM raw WHERE type = 'choice')",
    "event_properties": "SELECT event_type, json_extract(props, '$.k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "url_documents": "SELECT doc_id, 'docs.example.org/' || source || '?id=' || doc_id AS document FROM documents WHERE source IS NOT NULL",
    "length_summary": "SELECT kind, count(l) AS n, max(l)::INT AS largest, round(avg(l), 6) AS mean, " + ", ".join(f"trunc(quantile_cont(l, {q}))::BIGINT AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))) + " FROM (SELECT kind, length(text) AS l FROM documents) GROUP BY kind",
    "length_histogram": "SELECT bin::INT AS bin, count(*) FILTER (length(text) <= bin) AS n FROM documents, (SELECT unnest([64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384]) AS bin) GROUP BY bin",
    "length_retention": "SELECT cap::INT AS cap, count(*) FILTER (length(text) <= cap) AS kept, round(count(*) FILTER (length(text) <= cap) / count(text), 9) AS share FROM documents, (SELECT unnest([1024, 2048, 4096, 6144, 8192]) AS cap) GROUP BY cap",
    "recommended_cap": "SELECT min(cap) FILTER (share >= 0.99)::INT AS cap FROM (SELECT cap, count(*) FILTER (length(text) <= cap) / count(text) AS share FROM documents, (SELECT unnest([1024, 2048, 4096, 6144, 8192]) AS cap) GROUP BY cap)",
    "length_buckets": "SELECT ((length(text) - 1) // 128 * 128 + 128)::BIGINT AS bucket, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1",
    "head_budget": f"WITH {_D}, h AS (SELECT list_sum(list_transform(texts, lambda t: 1 + least(length(t) + 1, 48))) + length(instructions) AS w, len(option_keys) AS o, case_no FROM d) SELECT trunc(quantile_cont(w, 0.5))::BIGINT AS p50, trunc(quantile_cont(w, 0.99))::BIGINT AS p99, max(w)::INT AS largest, (ceil(arg_min(w, struct_pack(a := -o, b := case_no)) / 64) * 64)::BIGINT AS recommended FROM h",
    "value_counts": f"WITH {_D}, v AS (SELECT 'qtype' AS name, qtype AS value FROM d UNION ALL SELECT 'source', source FROM d UNION ALL SELECT 'n_options', len(option_keys)::VARCHAR FROM d) SELECT name, value, count(*) AS n FROM v GROUP BY ALL",
    "strict_items": f"WITH {_D}{_ITEMS.format(head=120, cap=320)} SELECT case_no, reason, CASE WHEN reason IS NULL THEN md5(array_to_string(list_concat(prefix, body[1:room], [2]), ',')) END AS ids, CASE WHEN reason IS NULL THEN array_to_string(list_transform(places, lambda x: x::BIGINT), ',') END AS markers, length(state)::INT AS state_tokens FROM items",
    "strict_reasons": f"WITH {_D}{_ITEMS.format(head=84, cap=260)} SELECT qtype, reason, count(*) AS n FROM items GROUP BY ALL",
    "rebuilt_items": f"""WITH {_D}{_LENIENT}, made AS (SELECT case_no, reason, CASE WHEN reason IS NULL AND len(prompt) + 1 <= 256 THEN list_concat(prompt, body[1:greatest(0, 255 - len(prompt))], [2]) END AS r,
  CASE WHEN reason IS NULL AND len(prompt) + 1 <= 128 THEN list_concat(prompt, CASE WHEN 127 - len(prompt) > 0 THEN body[greatest(1, len(body) - (127 - len(prompt)) + 1):] ELSE [] END, [2]) END AS l FROM lenient)
SELECT case_no, reason, len(r)::INT AS n_right, md5(array_to_string(r, ',')) AS right, md5(array_to_string(l, ',')) AS left FROM made""",
    "length_filters": f"WITH {_D}{_LENIENT} SELECT qtype, cap::INT AS cap, count(*) FILTER (len(prompt) + len(body) + 1 <= cap) AS whole, count(*) FILTER (len(prompt) + 1 <= cap) AS prompt FROM (SELECT qtype, prompt, body, unnest([128, 256, 512]) AS cap FROM lenient WHERE reason IS NULL) GROUP BY ALL",
    "padded_batches": f"WITH {_D}{_ITEMS.format(head=120, cap=320)}, own AS (SELECT case_no AS item, len(prefix) + len(body) + 1 AS length, n FROM items WHERE reason IS NULL), {_plan('own', 'item')} SELECT item, batch, max(p.length) OVER (PARTITION BY batch)::INT AS n_ids, max(n) OVER (PARTITION BY batch)::INT AS n_marks, max(p.length) OVER (PARTITION BY batch)::INT AS width FROM plan p JOIN own USING (item)",
    "padded_sequences": f"""WITH {_D}{_ITEMS.format(head=120, cap=320)}, own AS (SELECT case_no AS item, list_concat(prefix, body[1:room], [2]) AS ids, len(prefix) + len(body) + 1 AS length, n FROM items WHERE reason IS NULL), {_plan('own', 'item')},
wide AS (SELECT item, ids, n, max(p.length) OVER (PARTITION BY batch) AS width, max(n) OVER (PARTITION BY batch) AS marks FROM plan p JOIN own USING (item))
SELECT item, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)), ',')) AS ids, array_to_string(list_transform(range(marks), lambda i: (i < n)::INT), ',') AS mask FROM wide""",
    "token_batches": f"""WITH RECURSIVE {_DOCS}, ranked AS (SELECT doc_id, length, row_number() OVER (ORDER BY {_fraction("doc_id::VARCHAR", 5)}, doc_id) - 1 AS rank FROM docs),
placed AS (SELECT doc_id, length, rank // 1024 AS win, row_number() OVER (PARTITION BY rank // 1024 ORDER BY length, doc_id) AS spot FROM ranked),
packed AS (SELECT doc_id, length, win, spot, 0::BIGINT AS batch, 0 AS place, length AS width FROM placed WHERE spot = 1
  UNION ALL
  SELECT p.doc_id, p.length, p.win, p.spot, CASE WHEN k.width + p.length > 8192 THEN k.batch + 1 ELSE k.batch END, CASE WHEN k.width + p.length > 8192 THEN 0 ELSE k.place + 1 END, CASE WHEN k.width + p.length > 8192 THEN p.length ELSE k.width + p.length END
  FROM packed k JOIN placed p ON p.win = k.win AND p.spot = k.spot + 1)
SELECT doc_id, length::BIGINT AS length, win::BIGINT AS window, batch, place::INT AS place FROM packed""",
    "fixed_batches": f"WITH {_DOCS}, {_plan('docs', 'doc_id')} SELECT doc_id, win AS window, batch, place FROM plan",
    "epoch_batches": f"WITH {_DOCS}, {_plan('docs', 'doc_id')}, b AS (SELECT DISTINCT batch FROM plan), r AS (SELECT batch, row_number() OVER (ORDER BY {_fraction("'2:' || batch::VARCHAR", 5)}, batch) - 1 AS step FROM b) SELECT doc_id, batch, place, step FROM plan JOIN r USING (batch)",
    "shard_plan": f"WITH {_DOCS}, {_plan('docs', 'doc_id')}, b AS (SELECT DISTINCT batch FROM plan), r AS (SELECT batch, row_number() OVER (ORDER BY {_fraction('batch::VARCHAR', 0)}, batch) - 1 AS rank, count(*) OVER () AS total FROM b) SELECT batch, (rank % 8)::INT AS shard, (rank // 8)::BIGINT AS step, rank // 8 < total // 8 AS even FROM r",
    "seeded_subset": f"SELECT doc_id FROM documents ORDER BY {_fraction('doc_id::VARCHAR', 9)}, doc_id LIMIT 100",
    "two_largest": f"WITH {_P.format(t='1.0::DOUBLE')}, o AS (SELECT vec_id, list_reverse_sort(p) AS o FROM scored) SELECT vec_id, round(o[1], 8) AS first, round(o[2], 8) AS second, round(o[1] - o[2], 8) AS margin FROM o",
    "temperature_losses": f"""WITH {_P.format(t='1.0::DOUBLE')}, ts AS (SELECT unnest([0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 4.0, 8.0])::DOUBLE AS temperature)
SELECT qtype, temperature, round(avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / temperature)))) + list_max(logits) / temperature - list_sum(list_transform(logits, lambda x, i: target[i] * x)) / temperature), 8) AS loss FROM scored CROSS JOIN ts GROUP BY ALL""",
    "softmax_scores": f"WITH {_P.format(t=_T)} SELECT vec_id, qtype, round(confidence, 9) AS confidence, correct, round(log_score, 9) AS log_score FROM scored",
    "evaluation": f"WITH {_P.format(t='1.0::DOUBLE')} SELECT coalesce(qtype, 'all') AS qtype, count(*) AS items, round(avg(correct), 8) AS accuracy, round(avg(log_score), 8) AS mean_log_score, round(avg(confidence), 8) AS mean_confidence FROM scored GROUP BY GROUPING SETS ((), (qtype))",
    "calibration_error": f"WITH {_P.format(t='1.0::DOUBLE')}, b AS (SELECT qtype, greatest(1, ceil(confidence * 15)) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM scored GROUP BY ALL) SELECT qtype, round(sum(n * abs(c - a)) / sum(n), 8) AS ece FROM b GROUP BY qtype",
    "proper_rewards": f"""WITH {_P.format(t='1.0::DOUBLE')} SELECT vec_id, round(log_score + 0.5 * list_sum(list_transform(p, lambda x, i: x * target[i])) / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-9)
  - CASE WHEN qtype = 'score' THEN list_sum(list_transform(p, lambda x, i: pow(list_sum(p[1:i]) - list_sum(target[1:i]), 2))) / (k - 1) ELSE 0 END, 8) AS reward,
  round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(k))), 8) AS entropy_confidence FROM scored""",
}
