"""The base tables of ``operators.findings`` in DuckDB's SQL, for the comparison."""

SLUG = r"trim(regexp_replace(coalesce(nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[._-]?v?\d[\d.]*$', ''), ''), lower(trim({0}))), '[\s._-]+', '-', 'g'), '-')"
WEIGHT = "CASE ep WHEN 'ajax_nopriv' THEN 5.0 WHEN 'rest_api' THEN 4.0 WHEN 'shortcode' THEN 3.0 WHEN 'ajax_auth' THEN 2.5 WHEN 'admin' THEN 1.0 ELSE 0.5 END"
SCORE = f"round(CAST({WEIGHT} AS DOUBLE) + CASE WHEN inter THEN 1.0 ELSE 0.0 END + coalesce(conf, 0.6) + CASE WHEN deficit >= 0 THEN 0.5 * deficit ELSE 0.0 END, 9)"

BASE = {
    "F": r"""SELECT f.finding_id, f.finding_uid, f.run_uid, f.slug, f.cve, f.tool, f.rank, trim(replace(lower(f.file), '\', '/'), '/') AS path, f.line, a.vuln_class AS cls, f.message, f.source, f.sink,
  f."function" AS fn, f.interprocedural AS inter, CASE WHEN isnan(f.confidence) THEN NULL ELSE f.confidence END AS conf, f.entry_point AS ep, f.guard_deficit AS deficit, f.scanned_at, f.slug || '|' || coalesce(f.cve, '-') AS rkey
  FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at NULLS FIRST, file NULLS FIRST, vuln_class NULLS FIRST) AS n_ FROM findings) f
  LEFT JOIN class_aliases a ON lower(trim(f.vuln_class, ' ' || chr(9))) = a.alias WHERE f.n_ = 1""",
    "G": f"""SELECT record_id AS gid, {SLUG.format('slug')} AS slug, cve, trim(replace(lower(path), chr(92), '/'), '/') AS path, is_php, status, vuln_lines, patched_lines, changed_vuln_lines, insertion_boundaries, hunks, callable_ranges, top_level_changed_lines
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY path) AS n_ FROM patchmaps) WHERE n_ = 1""",
    "CL": "SELECT DISTINCT gid, line FROM (SELECT gid, unnest(changed_vuln_lines) AS line FROM G)",
    "BD": "SELECT DISTINCT gid, line FROM (SELECT gid, unnest(insertion_boundaries) AS line FROM G)",
    "HK": "SELECT DISTINCT gid, h.start AS h_start, h.\"end\" AS h_end, h.kind AS h_kind FROM (SELECT gid, unnest(hunks) AS h FROM G)",
    "RG": "SELECT DISTINCT gid, r.s AS s, r.e AS e FROM (SELECT gid, unnest(callable_ranges) AS r FROM G)",
    "RK": f"SELECT *, row_number() OVER (PARTITION BY rkey, tool ORDER BY score DESC, rank NULLS FIRST, finding_id) AS rk FROM (SELECT *, {SCORE} AS score FROM F)",
    "GEO": f"""SELECT f.*, g.gid, g.gid IS NOT NULL AS in_file,
  CASE WHEN coalesce(f.line, 0) > 0 THEN (SELECT min(abs(f.line - c.line)) FROM CL c WHERE c.gid = g.gid) END AS distance,
  EXISTS (SELECT 1 FROM HK h WHERE h.gid = g.gid AND f.line BETWEEN h.h_start AND h.h_end) AS in_hunk,
  EXISTS (SELECT 1 FROM BD b WHERE b.gid = g.gid AND (abs(f.line - b.line) <= 5 OR abs(f.line - (b.line + 1)) <= 5)) AS near_boundary
  FROM F f LEFT JOIN G g ON {SLUG.format('f.slug')} = g.slug AND f.cve IS NOT DISTINCT FROM g.cve AND f.path = g.path AND coalesce(g.is_php, true)""",
}
BASE["SC"] = """SELECT DISTINCT finding_id, gid FROM (SELECT g.finding_id, g.gid, c.line AS c, (SELECT first(struct_pack(s := r.s, e := r.e) ORDER BY r.e - r.s, r.s) FROM RG r WHERE r.gid = g.gid AND g.line BETWEEN r.s AND r.e) AS own,
  (SELECT first(struct_pack(s := r.s, e := r.e) ORDER BY r.e - r.s, r.s) FROM RG r WHERE r.gid = g.gid AND c.line BETWEEN r.s AND r.e) AS other FROM GEO g JOIN CL c ON c.gid = g.gid WHERE g.line > 0) WHERE own IS NOT DISTINCT FROM other"""
NEEDS = {"SC": ["GEO", "CL", "RG"], "CL": ["G"], "BD": ["G"], "HK": ["G"], "RG": ["G"], "RK": ["F"], "GEO": ["F", "G", "CL", "BD", "HK"]}
ORDER = ["F", "G", "CL", "BD", "HK", "RG", "RK", "GEO", "SC"]
