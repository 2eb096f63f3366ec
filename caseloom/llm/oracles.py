"""SQL of the queries in ``queries.py`` that SQL can express, for DuckDB."""

_SAMPLE = """
WITH named AS (
  SELECT {keep}, coalesce('id:' || {id}, 'row:' || {row}) AS identity FROM {table}
), numbered AS (
  SELECT *, ('0x' || substr(sha256('11|' || identity), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS n FROM named
)
SELECT {names}, round(n, 12) AS u FROM numbered WHERE n < 0.25
"""

# Components by keyed recursion: every case takes the smallest number among the cases that share a key with it.
_COMPONENTS = """
WITH RECURSIVE base AS (
  SELECT case_no, _meta.group_key AS group_key, _meta.link_keys AS links FROM cases
), uses AS (
  SELECT case_no, 'g' AS space, group_key AS k FROM base WHERE group_key IS NOT NULL
  UNION
  SELECT case_no, 'l', k FROM (SELECT case_no, unnest(links) AS k FROM base) WHERE k IS NOT NULL AND regexp_replace(k, '^[\\s\\x{{85}}\\p{{Z}}]+$', '') <> ''
), stars AS (
  SELECT DISTINCT case_no, min(case_no) OVER (PARTITION BY space, k) AS hub FROM uses
), steps AS (
  SELECT case_no AS a, hub AS b FROM stars UNION SELECT hub, case_no FROM stars
), found(case_no, component_no) USING KEY (case_no) AS (
  SELECT case_no, case_no FROM base
  UNION
  SELECT s.b, min(f.component_no) FROM found f JOIN steps s ON s.a = f.case_no JOIN recurring.found r ON r.case_no = s.b
  WHERE f.component_no < r.component_no GROUP BY s.b
), named AS (
  SELECT b.case_no, b.group_key, f.component_no FROM base b JOIN found f USING (case_no)
)
{select}
"""

_SPANNING = """SELECT case_no, component_no FROM named WHERE component_no IN (
  SELECT component_no FROM named GROUP BY component_no HAVING count(DISTINCT group_key) + count(*) FILTER (group_key IS NULL) >= 2)"""

_CONFLICTS = """SELECT DISTINCT r.grp FROM (
  SELECT grp, coalesce('c' || component_no::VARCHAR, 'g' || grp) AS component FROM groups
  LEFT JOIN (SELECT DISTINCT group_key, component_no FROM named WHERE group_key IS NOT NULL) ON group_key = grp WHERE grp IS NOT NULL) r
JOIN (
  SELECT component FROM (
    SELECT coalesce('c' || component_no::VARCHAR, 'g' || grp) AS component, lower(regexp_replace(regexp_replace(split, '^[\\s\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x{{85}}\\p{{Z}}]+$', '')) AS split
    FROM groups LEFT JOIN (SELECT DISTINCT group_key, component_no FROM named WHERE group_key IS NOT NULL) ON group_key = grp WHERE grp IS NOT NULL)
  WHERE split <> '' GROUP BY component HAVING count(DISTINCT split) > 1) t ON t.component = r.component"""

# A component's place in [0, 1) falls into fixed ranges; the ends are summed as the operator sums them.
_SPLITS = """SELECT DISTINCT group_key, component_no, CASE WHEN n < 0.8 THEN 'train' WHEN n < 0.9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(sha256('0:' || component_no), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS n FROM named WHERE group_key IS NOT NULL)"""

SQL = {
    "p5_splits": _COMPONENTS.format(select=_SPLITS),
    "p8_placed": "SELECT doc_id, true AS whole, 2048 AS capacity FROM documents WHERE text <> ''",
    "p1_sample_raw": _SAMPLE.format(keep="raw_no, id", id="id", row="raw_no::VARCHAR", table="raw", names="raw_no, id"),
    "p1_sample_cases": _SAMPLE.format(keep="case_no, _meta.group_key AS group_key", id="_meta.group_key", row="case_no::VARCHAR", table="cases", names="case_no, group_key"),
    "p3_components": _COMPONENTS.format(select="SELECT case_no, component_no FROM named"),
    "p3_found": _COMPONENTS.format(select=_SPANNING),
    "p5_found": _COMPONENTS.format(select=_CONFLICTS.replace("{{", "{").replace("}}", "}")),
}
