"""The reports' SQL for DuckDB, written apart from the DataFrames in ``frames``, for the comparison.

``@X`` stands for a base table as ``base_sql`` states it; plain names are tables of the data folder.
"""

from __future__ import annotations

import re

from plumbline.plans.base_sql import BASE, NEEDS, ORDER

REPORTS: dict[str, str] = {
    # scans and labels
    "s04_php_files": "SELECT slug, count(*) AS files, count(*) FILTER (WHERE path LIKE '%.php') AS exact_php, count(*) FILTER (WHERE lower(path) LIKE '%.php') AS any_php FROM source_files GROUP BY slug",
    "s05_skipped": "SELECT slug, count(*) AS files, count(*) FILTER (WHERE content IS NULL) AS unread, count(*) FILTER (WHERE content NOT LIKE '%<?%') AS no_tag FROM source_files WHERE lower(path) LIKE '%.php' GROUP BY slug",
    "s09_first_per_record": "SELECT slug, cve, path, n_paths > 1 AS conflict FROM (SELECT slug, cve, path, row_number() OVER (PARTITION BY slug, cve ORDER BY gid) AS n, CAST(count(path) OVER (PARTITION BY slug, cve) AS BIGINT) AS n_paths FROM @G WHERE cve IS NOT NULL) AS x WHERE n = 1",
    "s16_coverage": "SELECT CAST(sum(zips) AS BIGINT) AS zips, CAST(sum(zip_errors) AS BIGINT) AS zip_errors, CAST(sum(total_php_files) AS BIGINT) AS files, CAST(sum(skipped_no_open_tag) AS BIGINT) AS skipped, CAST(sum(parsed_files) AS BIGINT) AS parsed, CAST(sum(files_with_error) AS BIGINT) AS with_error, round(sum(files_with_error) * 1.0 / nullif(sum(parsed_files), 0), 9) AS file_error_rate, round(sum(error_bytes) * 1.0 / nullif(sum(parsed_bytes), 0), 9) AS byte_error_rate FROM parser_coverage",
    "s17_cve_years": "SELECT year, count(*) AS findings, count(DISTINCT rkey) AS records FROM (SELECT rkey, CASE WHEN cve LIKE 'CVE-____-%' THEN substr(cve, 5, 4) ELSE 'unknown' END AS year FROM @F) AS x GROUP BY year",
    # predicates
    "v05_environment": "SELECT finding_id FROM @F WHERE source = 'getenv' OR source LIKE '%HTTP_%' OR source IN ('$_SERVER', 'REQUEST_URI', 'QUERY_STRING')",
    "v10_sql_receivers": "SELECT sink, count(*) AS n, bool_or(lower(sink) LIKE '%wpdb%' OR lower(sink) LIKE '%get_results' OR lower(sink) LIKE '%get_row' OR lower(sink) LIKE '%get_var' OR lower(sink) LIKE '%get_col') AS receiver FROM @F GROUP BY sink",
    "v14_mined_names": "SELECT name, n, CASE WHEN name IN ('update_option', 'update_post_meta', 'update_user_meta', 'update_term_meta', 'update_metadata', 'update_site_option', 'add_option', 'delete_option', 'delete_post_meta', 'wp_update_post', 'wp_insert_post', 'wp_update_user') THEN 'benign' WHEN name LIKE '%get\\_param%' OR name LIKE '%request\\_var%' OR name LIKE '%read\\_input%' THEN 'source' WHEN name LIKE '%exec%' OR name LIKE '%shell%' OR name LIKE '%passthru%' OR name LIKE '%popen%' THEN 'rce' WHEN name LIKE '%put\\_contents%' OR name LIKE '%fwrite%' THEN 'upload' WHEN name LIKE '%get\\_contents%' OR name LIKE '%readfile%' THEN 'lfi' ELSE 'benign' END AS verdict FROM (SELECT lower(sink) AS name, count(*) AS n FROM @F WHERE sink IS NOT NULL GROUP BY lower(sink)) AS x",
    "v15_vendor_paths": "SELECT path, count(*) AS n FROM @F WHERE len(list_intersect(string_split(path, '/')[:-2], ['vendor', 'node_modules', 'assets', 'dist', 'build', 'languages', 'test', 'tests', '.github'])) > 0 OR list_contains(['css', 'scss', 'map', 'po', 'mo', 'pot', 'md', 'txt', 'json', 'lock', 'svg', 'png', 'jpg', 'jpeg', 'gif'], string_split(path, '.')[-1]) AND contains(path, '.') OR suffix(path, '.min.js') GROUP BY path",
    # scalar classifiers
    "f33_breadth": "SELECT rkey, n_cls, CASE WHEN n_cls = 1 THEN '1' WHEN n_cls <= 3 THEN '2-3' ELSE '4+' END AS band FROM (SELECT rkey, count(DISTINCT cls) AS n_cls FROM @F WHERE cls IS NOT NULL GROUP BY rkey) AS x",
    "f33_terciles": "SELECT rkey, n, CASE WHEN n <= (SELECT max(CASE WHEN i = CAST(floor(m / 3) AS BIGINT) + 1 THEN n END) FROM (SELECT n, row_number() OVER (ORDER BY n, rkey) AS i, count(*) OVER () AS m FROM (SELECT rkey, count(*) AS n FROM @F GROUP BY rkey) AS a) AS b) THEN 'small' WHEN n <= (SELECT max(CASE WHEN i = CAST(floor(2 * m / 3) AS BIGINT) + 1 THEN n END) FROM (SELECT n, row_number() OVER (ORDER BY n, rkey) AS i, count(*) OVER () AS m FROM (SELECT rkey, count(*) AS n FROM @F GROUP BY rkey) AS a) AS b) THEN 'medium' ELSE 'large' END AS tercile FROM (SELECT rkey, count(*) AS n FROM @F GROUP BY rkey) AS x",
    "f34_mechanism": "SELECT mechanism, count(*) AS n FROM (SELECT CASE WHEN cls IN ('auth', 'csrf') THEN 'missing-guard' WHEN lower(source) LIKE '%unserialize(untrusted)%' THEN 'risk-pattern' ELSE 'proven-taint' END AS mechanism FROM @F WHERE cls IS NOT NULL) AS x GROUP BY mechanism",
    "f35_signatures": "SELECT signature, count(*) AS n FROM (SELECT CASE WHEN lower(source) LIKE '%unserialize(untrusted)%' THEN 'risk:unserialize' ELSE cls || ':' || regexp_replace(sink, '^[$>-]+', '') END AS signature FROM @F WHERE cls IS NOT NULL AND sink IS NOT NULL) AS x GROUP BY signature",
    "f36_tiers": "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN cls IN ('csrf', 'auth') OR coalesce(conf, 0.6) <= 0.45 THEN 1 WHEN lower(sink) LIKE '%wpdb%' OR lower(sink) IN ('echo', 'print', 'printf', 'eval', 'move_uploaded_file', 'unlink') THEN 3 ELSE 2 END AS tier FROM @F) AS x GROUP BY tier",
    # joins
    "j11_in_patch": "SELECT finding_id, bool_or(in_file) AS in_file FROM @GEO GROUP BY finding_id",
    "j12_outside": "SELECT f.finding_id FROM @F f WHERE NOT EXISTS (SELECT 1 FROM @GEO g WHERE g.finding_id = f.finding_id AND g.in_file)",
    "j13_window": "SELECT g.finding_id, g.gid, count(*) AS near FROM @GEO g JOIN @CL c ON c.gid = g.gid AND c.line BETWEEN g.line - 5 AND g.line + 5 GROUP BY g.finding_id, g.gid",
    "j14_innermost": "SELECT finding_id, gid, s, e FROM (SELECT g.finding_id, g.gid, r.s, r.e, row_number() OVER (PARTITION BY g.finding_id, g.gid ORDER BY r.e - r.s, r.s, r.e) AS n FROM @GEO g JOIN @RG r ON r.gid = g.gid AND g.line BETWEEN r.s AND r.e) AS x WHERE n = 1",
    "j16_hunks": "SELECT g.finding_id, g.gid, h.h_start, h.h_end, h.h_kind FROM @GEO g JOIN @HK h ON h.gid = g.gid AND g.line BETWEEN h.h_start AND h.h_end",
    "j17_deficits": "SELECT f.finding_id, CASE WHEN f.cls IN ('csrf', 'auth') AND f.source = 'request' THEN coalesce(d.d, 1.0) ELSE -1.0 END AS deficit FROM @F f LEFT JOIN (SELECT slug, path, line, cls, max(deficit) AS d FROM @F WHERE deficit >= 0 GROUP BY slug, path, line, cls) AS d ON f.slug = d.slug AND f.path = d.path AND f.line = d.line AND f.cls = d.cls",
    "j18_file_entry": "SELECT slug, path, min(CASE ep WHEN 'ajax_nopriv' THEN 1 WHEN 'ajax_auth' THEN 2 WHEN 'rest_api' THEN 3 WHEN 'shortcode' THEN 4 WHEN 'admin' THEN 5 ELSE 9 END) AS priority FROM @F GROUP BY slug, path",
    "j20_common_records": "SELECT a.rkey FROM (SELECT DISTINCT rkey FROM @F WHERE tool = 'wpt') AS a JOIN (SELECT DISTINCT rkey FROM @F WHERE tool = 'progpilot') AS b ON a.rkey = b.rkey",
    "j21_full_denominator": "SELECT r.rkey, t.tool, coalesce(h.hit, 0) AS hit FROM (SELECT DISTINCT rkey FROM @F) AS r JOIN (SELECT DISTINCT tool FROM @F) AS t ON true LEFT JOIN (SELECT rkey, tool, max(CASE WHEN in_file THEN 1 ELSE 0 END) AS hit FROM @GEO GROUP BY rkey, tool) AS h ON h.rkey = r.rkey AND h.tool = t.tool",
    "j22_all_tools": "SELECT rkey FROM @F GROUP BY rkey HAVING count(DISTINCT tool) = (SELECT count(DISTINCT tool) FROM @F)",
    "j23_manifest": "SELECT p.record_id, p.slug, c.total_php_files, c.record_id IS NOT NULL AS listed FROM (SELECT DISTINCT record_id, slug FROM plugins) AS p LEFT JOIN (SELECT record_id, max(total_php_files) AS total_php_files FROM parser_coverage GROUP BY record_id) AS c ON p.record_id = c.record_id",
    "j23_extra": "SELECT DISTINCT p.record_id FROM plugins p WHERE p.record_id NOT IN (SELECT record_id FROM parser_coverage WHERE record_id IS NOT NULL)",
    "j24_before_after": "SELECT coalesce(a.rkey, b.rkey) AS rkey, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'gained' WHEN b.n IS NULL THEN 'lost' WHEN b.n > a.n THEN 'more' WHEN b.n < a.n THEN 'fewer' ELSE 'same' END AS change FROM (SELECT rkey, count(*) AS n FROM @F WHERE tool = 'wpt' GROUP BY rkey) AS a FULL OUTER JOIN (SELECT rkey, count(*) AS n FROM @F WHERE tool = 'progpilot' GROUP BY rkey) AS b ON a.rkey = b.rkey",
    "j25_multiset": "SELECT path, line, cls, sink, CASE WHEN d > 0 THEN 'wpt' ELSE 'progpilot' END AS more, abs(d) AS times FROM (SELECT path, line, cls, sink, CAST(sum(CASE tool WHEN 'wpt' THEN 1 WHEN 'progpilot' THEN -1 ELSE 0 END) AS BIGINT) AS d FROM @F GROUP BY path, line, cls, sink) AS x WHERE d <> 0",
    # aggregations
    "a01_keep_best": "SELECT slug, path, line, cls, sink, finding_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY slug, path, line, cls, sink ORDER BY coalesce(conf, -1.0) DESC, finding_id) AS n FROM @F) AS x WHERE n = 1",
    "a02_cap_one": "SELECT slug, path, finding_id FROM (SELECT slug, path, finding_id, row_number() OVER (PARTITION BY slug, path ORDER BY rank NULLS FIRST, finding_id) AS n FROM @F WHERE cls = 'deserial') AS x WHERE n = 1",
    "a03_classes": "SELECT coalesce(cls, 'none') AS cls, count(*) AS n FROM @F GROUP BY coalesce(cls, 'none')",
    "a04_emission": "SELECT coalesce(cls, 'ALL') AS cls, count(*) AS records, count(*) FILTER (WHERE hit) AS hits FROM (SELECT rkey, cls, bool_or(in_file) AS hit FROM @GEO WHERE cls IS NOT NULL GROUP BY rkey, cls) AS x GROUP BY ROLLUP (cls)",
    "a05_shard_merge": "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) * 1.0 / sum(n), 9) AS rate FROM (SELECT tool, count(*) AS n, count(*) FILTER (WHERE in_file) AS hits FROM @GEO GROUP BY tool) AS x",
    "a06_precision": "SELECT tool, round(count(*) FILTER (WHERE in_file) * 1.0 / count(*), 9) AS file_precision, round(count(*) FILTER (WHERE distance <= 5) * 1.0 / count(*), 9) AS line_precision, round(count(*) FILTER (WHERE (finding_id, gid) IN (SELECT (finding_id, gid) FROM @SC)) * 1.0 / count(*), 9) AS function_precision, count(DISTINCT CASE WHEN in_file THEN gid END) AS files_found, round(count(DISTINCT CASE WHEN in_file THEN gid END) * 1.0 / (SELECT count(*) FROM @G WHERE coalesce(is_php, true)), 9) AS file_recall FROM @GEO GROUP BY tool",
    "a08_micro_macro": "SELECT round(sum(h) * 1.0 / count(*), 9) AS micro, round((SELECT avg(m) FROM (SELECT slug, avg(h) AS m FROM (SELECT slug, rkey, max(CASE WHEN in_file THEN 1.0 ELSE 0.0 END) AS h FROM @GEO GROUP BY slug, rkey) AS a GROUP BY slug) AS b), 9) AS macro FROM (SELECT slug, rkey, max(CASE WHEN in_file THEN 1.0 ELSE 0.0 END) AS h FROM @GEO GROUP BY slug, rkey) AS x",
    "a09_class_macro": "SELECT round(avg(coalesce(r, 0.0)), 9) AS absent_as_zero, round(avg(r), 9) AS absent_skipped FROM (SELECT DISTINCT vuln_class FROM class_aliases) AS c LEFT JOIN (SELECT cls, avg(CASE WHEN in_file THEN 1.0 ELSE 0.0 END) AS r FROM @GEO GROUP BY cls) AS g ON c.vuln_class = g.cls",
    "a10_confusion": "SELECT a.cls AS a, b.cls AS b, count(*) AS n FROM @F a JOIN @F b ON a.slug = b.slug AND a.path = b.path AND a.line = b.line WHERE a.tool = 'wpt' AND b.tool = 'progpilot' AND a.cls IS NOT NULL AND b.cls IS NOT NULL GROUP BY a.cls, b.cls",
    "a12_histogram": "SELECT n, count(*) AS plugins FROM (SELECT slug, count(DISTINCT rkey) AS n FROM @F GROUP BY slug) AS x GROUP BY n",
    "a14_accounting": "SELECT count(*) AS releases, count(*) FILTER (WHERE r IS NULL) AS unknown, count(*) FILTER (WHERE r = 0) AS closed, count(*) FILTER (WHERE r > 0) AS files_missing, count(*) FILTER (WHERE r < 0) AS files_too_many FROM (SELECT total_php_files - (parsed_files + skipped_no_open_tag) AS r FROM parser_coverage) AS x",
    "a17_patch_shapes": "SELECT shape, count(*) AS files FROM (SELECT CASE WHEN status <> 'modified' THEN status WHEN changed = 0 THEN 'insert-only' WHEN changed <= 5 THEN 'small' ELSE 'large' END AS shape FROM (SELECT g.gid, g.status, count(c.line) AS changed FROM @G g LEFT JOIN @CL c ON c.gid = g.gid GROUP BY g.gid, g.status) AS y) AS x GROUP BY shape",
    "a18_medians": "SELECT tool, median(line) AS line, median(conf) AS conf FROM @F GROUP BY tool",
    "a19_reliability": "SELECT cls, sink, round((hits + 0.5) / (n + 5.0), 9) AS reliability FROM (SELECT cls, sink, count(*) AS n, count(*) FILTER (WHERE in_file) AS hits FROM @GEO WHERE cls IS NOT NULL GROUP BY cls, sink) AS x UNION ALL SELECT DISTINCT vuln_class, '(unseen)', 0.1 FROM class_aliases",
    "a20_burials": "SELECT r.cls, r.sink, count(*) AS times FROM @RK r JOIN (SELECT k.rkey, k.tool, min(k.rk) AS first FROM @RK k JOIN (SELECT DISTINCT finding_id FROM @GEO WHERE in_file) AS g ON g.finding_id = k.finding_id GROUP BY k.rkey, k.tool) AS f ON r.rkey = f.rkey AND r.tool = f.tool AND r.rk < f.first GROUP BY r.cls, r.sink",
    "a21_name_collisions": "SELECT count(*) AS names, count(*) FILTER (WHERE files > 1) AS ambiguous, CAST(sum(across) AS BIGINT) AS across, CAST(coalesce(sum(across) FILTER (WHERE files > 1), 0) AS BIGINT) AS across_ambiguous FROM (SELECT slug, fn, count(DISTINCT path) AS files, count(*) FILTER (WHERE inter) AS across FROM @F WHERE fn IS NOT NULL GROUP BY slug, fn) AS x",
    "a23_budget_curve": "SELECT b.budget, h.tool, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM (SELECT k.rkey, k.tool, k.rk FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id WHERE g.in_file) AS q WHERE q.rkey = h.rkey AND q.tool = h.tool AND q.rk <= b.budget)) AS hits, round(hits * 1.0 / n, 9) AS rate FROM (SELECT DISTINCT rkey, tool FROM @F) AS h CROSS JOIN (VALUES (1), (3), (10), (30), (100)) AS b(budget) GROUP BY b.budget, h.tool",
    "a24_cohorts": "SELECT CASE WHEN cve IS NULL THEN 'unknown' ELSE substr(cve, 5, 4) END AS year, count(DISTINCT rkey) AS records, round(avg(CASE WHEN in_file THEN 1.0 ELSE 0.0 END), 9) AS rate FROM @GEO GROUP BY 1",
    "a29_ceiling": "SELECT cls, count(*) AS records, count(*) FILTER (WHERE hit) AS reachable, count(*) FILTER (WHERE hit AND NOT first) AS recoverable FROM (SELECT g.rkey, g.cls, bool_or(g.in_file) AS hit, bool_or(g.in_file AND k.rk = 1) AS first FROM @GEO g JOIN @RK k ON k.finding_id = g.finding_id WHERE g.cls IS NOT NULL GROUP BY g.rkey, g.cls) AS x GROUP BY cls",
    "a30_predicates": "SELECT count(*) FILTER (WHERE in_hunk AND coalesce(distance, 99) > 0) AS hunk_not_exact, count(*) FILTER (WHERE coalesce(distance, 99) = 0 AND NOT in_hunk) AS exact_not_hunk, count(*) FILTER (WHERE in_hunk AND NOT in_file) AS hunk_not_file FROM @GEO",
    # rankings
    "k03_top_k": "SELECT k.tool, n.k, count(DISTINCT k.rkey) AS records, count(DISTINCT CASE WHEN g.in_file AND k.rk <= n.k THEN k.rkey END) AS hits FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 10) AS n ON true GROUP BY k.tool, n.k",
    "k04_precision_at_k": "SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(m) AS BIGINT) AS shown, round(sum(tp) * 1.0 / sum(m), 9) AS precision_5 FROM (SELECT k.tool, k.rkey, count(DISTINCT CASE WHEN g.in_file THEN k.finding_id END) AS tp, least(5, count(DISTINCT k.finding_id)) AS m FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id WHERE k.rk <= 5 GROUP BY k.tool, k.rkey) AS x GROUP BY tool",
    "k05_first_hits": "SELECT k.rkey, k.tool, min(k.rk) FILTER (WHERE g.in_file) AS first_file, min(k.rk) FILTER (WHERE g.distance <= 5) AS first_near, min(k.rk) FILTER (WHERE g.distance <= 2) AS first_within2, min(k.rk) FILTER (WHERE g.distance <= 10) AS first_within10, min(k.rk) FILTER (WHERE g.distance = 0) AS first_exact, min(k.rk) FILTER (WHERE g.in_hunk) AS first_hunk, min(k.rk) FILTER (WHERE s.gid IS NOT NULL) AS first_callable, min(k.rk) FILTER (WHERE g.near_boundary) AS first_boundary, min(k.rk) FILTER (WHERE g.in_file AND g.line > 0 AND NOT EXISTS (SELECT 1 FROM @RG r WHERE r.gid = g.gid AND g.line BETWEEN r.s AND r.e)) AS first_top FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id LEFT JOIN @SC s ON s.finding_id = g.finding_id AND s.gid = g.gid GROUP BY k.rkey, k.tool",
    "k06_miss_buckets": "SELECT tool, bucket, count(*) AS records FROM (SELECT rkey, tool, CASE WHEN NOT named THEN 'no_class' WHEN first IS NULL THEN 'wrong_file' WHEN first > 1 THEN 'ranked_below_1' ELSE 'at_1' END AS bucket FROM (SELECT k.rkey, k.tool, bool_or(k.cls IS NOT NULL) AS named, min(CASE WHEN g.in_file THEN k.rk END) AS first FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id GROUP BY k.rkey, k.tool) AS y) AS x GROUP BY tool, bucket",
    "k09_variants": "SELECT w.flow, count(*) AS lists, count(*) FILTER (WHERE x.changed) AS changed FROM (SELECT 0.0 AS flow UNION ALL SELECT 2.0 UNION ALL SELECT 4.0) AS w JOIN (SELECT w2.flow, k.rkey, k.tool, bool_or(k.rk = 1 AND k.n2 <> 1) AS changed FROM (SELECT rkey, tool, rk, finding_id, w1.flow, row_number() OVER (PARTITION BY w1.flow, rkey, tool ORDER BY round(score + (w1.flow - 1.0) * coalesce(conf, 0.6), 6) DESC, rank NULLS FIRST, finding_id) AS n2 FROM @RK JOIN (SELECT 0.0 AS flow UNION ALL SELECT 2.0 UNION ALL SELECT 4.0) AS w1 ON true) AS k JOIN (SELECT 0.0 AS flow UNION ALL SELECT 2.0 UNION ALL SELECT 4.0) AS w2 ON w2.flow = k.flow GROUP BY w2.flow, k.rkey, k.tool) AS x ON x.flow = w.flow GROUP BY w.flow",
    "k12_random_order": "SELECT seed, count(DISTINCT CASE WHEN hit AND n <= 3 THEN rkey END) AS hits FROM (SELECT s.seed, f.rkey, h.hit, row_number() OVER (PARTITION BY s.seed, f.rkey, f.tool ORDER BY md5(s.seed || '|' || f.finding_uid), f.finding_id) AS n FROM @F f JOIN (SELECT finding_id, bool_or(in_file) AS hit FROM @GEO GROUP BY finding_id) AS h ON h.finding_id = f.finding_id CROSS JOIN range(1, 101) AS s(seed)) AS x GROUP BY seed",
    "k13_top_sinks": "SELECT cls, sink, n FROM (SELECT cls, sink, n, row_number() OVER (PARTITION BY cls ORDER BY n DESC, sink) AS i FROM (SELECT cls, sink, count(*) AS n FROM @F WHERE cls IS NOT NULL AND sink IS NOT NULL GROUP BY cls, sink) AS y) AS x WHERE i <= 3",
    "k14_occurrence": "SELECT finding_id, row_number() OVER (PARTITION BY rkey, tool, path, line, cls ORDER BY finding_id) - 1 AS occurrence FROM @F",
    "k17_runs": "SELECT tool, count(*) FILTER (WHERE before IS NULL OR before <> cls) AS runs, count(*) AS n FROM (SELECT tool, cls, lag(cls) OVER (PARTITION BY tool ORDER BY finding_id) AS before FROM @F WHERE cls IS NOT NULL) AS x GROUP BY tool",
    # sets
    "set_union": "SELECT DISTINCT sink AS name FROM @F WHERE tool = 'wpt' AND sink IS NOT NULL UNION SELECT DISTINCT sink FROM @F WHERE tool = 'progpilot' AND sink IS NOT NULL",
    "set_intersection": "SELECT rkey FROM @F WHERE tool = 'wpt' INTERSECT SELECT rkey FROM @F WHERE tool = 'semgrep'",
    "set_difference": "SELECT rkey FROM @F WHERE tool <> 'progpilot' EXCEPT SELECT rkey FROM @F WHERE tool = 'progpilot'",
    "set_round_robin": "SELECT finding_id FROM (SELECT finding_id, i, cls, tool, row_number() OVER (ORDER BY i, cls, tool) AS n FROM (SELECT finding_id, cls, tool, row_number() OVER (PARTITION BY cls, tool ORDER BY md5('7|' || finding_uid)) AS i FROM @F WHERE cls IS NOT NULL) AS y) AS x WHERE n <= 200",
    # patches
    "x03_statuses": "SELECT slug, cve, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'added') AS added FROM @G GROUP BY slug, cve",
    "x04_unanchorable": "SELECT count(*) AS files, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'modified' AND NOT EXISTS (SELECT 1 FROM @CL c WHERE c.gid = g.gid)) AS insert_only FROM @G g" ,
    "x05_geometry": "SELECT finding_id, gid, in_file, distance, coalesce(distance <= 2, false) AS within2, coalesce(distance <= 5, false) AS within5, coalesce(distance <= 10, false) AS within10, in_hunk, near_boundary FROM @GEO",
    "x09_withheld": "SELECT g.finding_id, g.gid, b.slug IS NOT NULL AS withheld, g.in_file AND b.slug IS NULL AS in_file, coalesce(g.distance <= 5, false) AND b.slug IS NULL AS within5, g.in_hunk AND b.slug IS NULL AS in_hunk, g.near_boundary FROM @GEO g LEFT JOIN (SELECT DISTINCT slug FROM parser_coverage WHERE files_with_error > 0 AND slug IS NOT NULL) AS b ON b.slug = g.slug",
    # statistics without resampling
    "t06_weighted_rate": "SELECT round(sum(m * p) / sum(m), 9) AS rate FROM (SELECT cls, tool, count(*) AS m, avg(CASE WHEN in_file THEN 1.0 ELSE 0.0 END) AS p FROM @GEO WHERE cls IS NOT NULL GROUP BY cls, tool) AS x",
    "t08_inverse_weights": "SELECT round(sum(CASE WHEN in_file THEN w ELSE 0.0 END) / sum(w), 9) AS rate FROM (SELECT in_file, 1.0 / count(*) OVER (PARTITION BY slug) AS w FROM @GEO) AS x",
    "t13_kappa": "SELECT CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 9) END AS kappa, n FROM (SELECT n, agree * 1.0 / n AS po, (a1 * 1.0 / n) * (b1 * 1.0 / n) + (1 - a1 * 1.0 / n) * (1 - b1 * 1.0 / n) AS pe FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a = 1) AS a1, count(*) FILTER (WHERE b = 1) AS b1 FROM (SELECT rkey, coalesce(max(CASE WHEN tool = 'wpt' AND in_file THEN 1 END), 0) AS a, coalesce(max(CASE WHEN tool = 'progpilot' AND in_file THEN 1 END), 0) AS b FROM @GEO GROUP BY rkey) AS z) AS y) AS x",
    "t14_pabak": "SELECT round((2 * (agree * 1.0 / n) - 1), 9) AS pabak FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM (SELECT rkey, coalesce(max(CASE WHEN tool = 'wpt' AND in_file THEN 1 END), 0) AS a, coalesce(max(CASE WHEN tool = 'progpilot' AND in_file THEN 1 END), 0) AS b FROM @GEO GROUP BY rkey) AS y) AS x",
    "t15_fleiss": "WITH k AS (SELECT CAST(count(DISTINCT tool) AS DOUBLE) AS k FROM @F) SELECT round((p - e) / (1 - e), 9) AS kappa FROM (SELECT avg((h * h + (k - h) * (k - h) - k) / (k * (k - 1))) AS p, pow(avg(h / k), 2) + pow(1 - avg(h / k), 2) AS e FROM (SELECT rkey, CAST(count(DISTINCT CASE WHEN in_file THEN tool END) AS DOUBLE) AS h FROM @GEO GROUP BY rkey) AS y CROSS JOIN k) AS x",
    "t16_spearman": "SELECT tool, round(corr(ra, rb), 9) AS rho FROM (SELECT tool, rank() OVER (PARTITION BY tool ORDER BY conf) + (count(*) OVER (PARTITION BY tool, conf) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY tool ORDER BY line) + (count(*) OVER (PARTITION BY tool, line) - 1) / 2.0 AS rb FROM @F WHERE conf IS NOT NULL AND line IS NOT NULL) AS x GROUP BY tool",
    "t19_log_fit": "SELECT round(regr_slope(y, x), 7) AS slope, round(regr_intercept(y, x), 7) AS intercept, round(regr_r2(y, x), 7) AS r2, count(*) AS n FROM (SELECT ln(CAST(parsed_bytes AS DOUBLE)) AS y, ln(CAST(total_php_files AS DOUBLE)) AS x FROM parser_coverage WHERE parsed_bytes > 0 AND total_php_files > 0) AS z",
    "t23_transitions": "SELECT tool, round(h * 1.0 / nullif(f, 0), 9) AS hunk_given_file, round(d * 1.0 / nullif(f, 0), 9) AS near_given_file, round(s * 1.0 / nullif(f, 0), 9) AS callable_given_file, f - d AS lost_near, f - s AS lost_callable FROM (SELECT g.tool, count(*) FILTER (WHERE in_file) AS f, count(*) FILTER (WHERE in_hunk) AS h, count(*) FILTER (WHERE distance <= 5) AS d, count(s.gid) AS s FROM @GEO g LEFT JOIN @SC s ON s.finding_id = g.finding_id AND s.gid = g.gid GROUP BY g.tool) AS x",
    "t24_brackets": "SELECT round(avg(CASE WHEN cls IS NOT NULL THEN CASE WHEN in_file THEN 1.0 ELSE 0.0 END END), 9) AS excluded, round(avg(CASE WHEN cls IS NOT NULL AND in_file THEN 1.0 ELSE 0.0 END), 9) AS failed, round(avg(CASE WHEN cls IS NULL OR in_file THEN 1.0 ELSE 0.0 END), 9) AS passed FROM @GEO",
    "t26_failure_arms": "SELECT arm, count(*) AS n, count(*) FILTER (WHERE CASE arm WHEN 'kept' THEN in_file WHEN 'miss' THEN in_file AND conf IS NOT NULL ELSE in_file AND conf IS NOT NULL END) AS hits FROM @GEO JOIN (SELECT 'kept' AS arm UNION ALL SELECT 'miss' UNION ALL SELECT 'excluded') AS a ON arm <> 'excluded' OR conf IS NOT NULL GROUP BY arm",
    "t27_three_arms": "SELECT a, b, c, count(*) AS records FROM (SELECT rkey, max(CASE WHEN tool = 'wpt' AND in_file THEN 1 ELSE 0 END) AS a, max(CASE WHEN tool = 'progpilot' AND in_file THEN 1 ELSE 0 END) AS b, max(CASE WHEN tool = 'semgrep' AND in_file THEN 1 ELSE 0 END) AS c FROM @GEO GROUP BY rkey) AS x GROUP BY a, b, c",
    # assertions
    "q02_leaks": "SELECT cell, leak, count(DISTINCT finding_id) AS findings FROM (SELECT finding_id, cell, CASE WHEN len(list_intersect(regexp_split_to_array(lower(value), '[^a-z0-9_]+'), ['semgrep', 'progpilot', 'wpt'])) > 0 THEN 'tool' WHEN regexp_full_match(lower(value), '[a-z0-9_-]+(\\.[a-z0-9_-]+){2,}') THEN 'rule' END AS leak FROM (SELECT finding_id, 'message' AS cell, message AS value FROM findings UNION ALL SELECT finding_id, 'source', source FROM findings UNION ALL SELECT finding_id, 'sink', sink FROM findings UNION ALL SELECT finding_id, 'entry_point', entry_point FROM findings) AS u) AS x WHERE leak IS NOT NULL GROUP BY cell, leak",
    "q03_orphans": "SELECT DISTINCT uid FROM (SELECT regexp_replace(replace(lower(finding_uid), 'urn:uuid:', ''), '[^0-9a-f]', '', 'g') AS uid FROM study_sample WHERE finding_uid IS NOT NULL) AS s WHERE uid NOT IN (SELECT regexp_replace(lower(finding_uid), '[^0-9a-f]', '', 'g') FROM findings WHERE finding_uid IS NOT NULL)",
    "q05_drift": "SELECT p.slug, p.files AS shipped, c.files AS counted FROM (SELECT record_id, max(slug) AS slug, max(total_php_files) AS files FROM parser_coverage GROUP BY record_id) AS p JOIN (SELECT record_id, count(*) AS files FROM source_files WHERE lower(path) LIKE '%.php' GROUP BY record_id) AS c ON p.record_id = c.record_id WHERE p.files IS DISTINCT FROM c.files",
    "q06_disputed": "SELECT a.slug, a.path, a.line, min(a.cls) AS a, min(b.cls) AS b FROM @F a JOIN @F b ON a.slug = b.slug AND a.path = b.path AND a.line = b.line WHERE a.tool = 'wpt' AND b.tool = 'progpilot' AND a.cls <> b.cls GROUP BY a.slug, a.path, a.line",
    "q11_failure_policy": "SELECT record_id, CASE WHEN zip_errors > 0 THEN 'error' WHEN files_with_error > 0 THEN 'non_converged' END AS reason FROM parser_coverage",
    # more joins, sums and checks
    "s12_resolved": "SELECT p.record_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL THEN 'named' WHEN b.path IS NOT NULL THEN 'first' END AS how FROM (SELECT DISTINCT record_id, slug FROM plugins) AS p LEFT JOIN (SELECT record_id, min(path) AS path FROM source_files WHERE lower(path) LIKE '%/index.php' GROUP BY record_id) AS a ON a.record_id = p.record_id LEFT JOIN (SELECT record_id, min(path) AS path FROM source_files GROUP BY record_id) AS b ON b.record_id = p.record_id",
    "v01_vocabulary": "SELECT vuln_class, count(*) AS names, min(alias) AS first FROM class_aliases GROUP BY vuln_class",
    "v03_shadowed": "SELECT DISTINCT a.sink FROM @F a WHERE EXISTS (SELECT 1 FROM @F b WHERE b.slug = a.slug AND lower(b.fn) = lower(a.sink))",
    "v13_slices": "SELECT finding_id, CASE WHEN message LIKE '%esc\\_%' OR message LIKE '%sanitize\\_%' THEN 'guarded' WHEN source LIKE '$\\_%' THEN 'likely' ELSE 'unclear' END AS reachability FROM @F",
    "a07_class_sets": "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS missed, round(sum(tp) * 1.0 / nullif(sum(tp) + sum(fp), 0), 9) AS precision_proxy, round(sum(tp) * 1.0 / nullif(sum(tp) + sum(fn), 0), 9) AS recall FROM (SELECT coalesce(a.slug, b.slug) AS slug, count(*) FILTER (WHERE a.cls IS NOT NULL AND b.cls IS NOT NULL) AS tp, count(*) FILTER (WHERE b.cls IS NULL) AS fp, count(*) FILTER (WHERE a.cls IS NULL) AS fn FROM (SELECT DISTINCT slug, cls FROM @F WHERE tool = 'wpt' AND cls IS NOT NULL) AS a FULL OUTER JOIN (SELECT DISTINCT slug, cls FROM @F WHERE tool <> 'wpt' AND cls IS NOT NULL) AS b ON a.slug = b.slug AND a.cls = b.cls GROUP BY coalesce(a.slug, b.slug)) AS x",
    "a11_rates": "SELECT *, round(tp * 1.0 / nullif(tp + missed, 0), 9) AS tpr, round(tn * 1.0 / nullif(tn + fp, 0), 9) AS tnr FROM (SELECT coalesce(ep, 'ALL') AS ep, count(*) FILTER (WHERE in_file AND inter) AS tp, count(*) FILTER (WHERE NOT in_file AND NOT inter) AS tn, count(*) FILTER (WHERE in_file AND NOT inter) AS missed, count(*) FILTER (WHERE NOT in_file AND inter) AS fp FROM @GEO WHERE inter IS NOT NULL AND ep IS NOT NULL GROUP BY ROLLUP (ep)) AS x",
    "a13_failures": "SELECT CASE WHEN zip_errors > 0 THEN 'archive' WHEN files_with_error > 0 THEN 'syntax' WHEN skipped_no_open_tag > 0 THEN 'no tag' ELSE 'none' END AS cause, count(*) AS releases, CAST(sum(total_php_files) AS BIGINT) AS files FROM parser_coverage GROUP BY 1",
    "a15_census": "SELECT count(*) AS releases, count(*) FILTER (WHERE files_with_error = 0) AS clean, count(*) FILTER (WHERE files_with_error IS NULL) AS unknown, round(count(*) FILTER (WHERE files_with_error = 0) * 1.0 / count(files_with_error), 9) AS rate_of_known FROM parser_coverage",
    "a16_transitions": "SELECT before, after, count(*) AS n FROM (SELECT a.finding_uid, coalesce(CAST(a.wave_id AS BIGINT), 0) AS before, min(b.wave_id) AS after FROM study_sample a LEFT JOIN study_sample b ON a.finding_uid = b.finding_uid AND b.wave_id > a.wave_id GROUP BY a.finding_uid, a.wave_id) AS x GROUP BY before, after",
    "a22_throughput": "SELECT tool, lists, round(d * 1.0 / lists, 9) AS completed, round(h * 1.0 / nullif(d, 0), 9) AS accuracy, round((SELECT max(d2 * 1.0 / l2) FROM (SELECT tool, count(DISTINCT rkey) FILTER (WHERE conf IS NOT NULL) AS d2, count(DISTINCT rkey) AS l2 FROM @GEO GROUP BY tool) AS b) * h / nullif(d, 0), 9) AS counterfactual FROM (SELECT tool, count(*) AS lists, count(*) FILTER (WHERE done) AS d, count(*) FILTER (WHERE done AND hit) AS h FROM (SELECT rkey, tool, bool_or(conf IS NOT NULL) AS done, bool_or(in_file) AS hit FROM @GEO GROUP BY rkey, tool) AS y GROUP BY tool) AS x",
    "a25_auth_split": "SELECT coalesce(part, 'ALL') AS part, count(*) AS n FROM (SELECT CASE WHEN deficit >= 1 THEN 'unguarded' WHEN deficit >= 0 THEN 'partly' ELSE 'not applicable' END AS part FROM @F WHERE cls = 'auth') AS x GROUP BY ROLLUP (part)",
    "a26_best_of_file": "SELECT slug, path, max(CASE ep WHEN 'ajax_nopriv' THEN 5.0 WHEN 'rest_api' THEN 4.0 WHEN 'shortcode' THEN 3.0 WHEN 'ajax_auth' THEN 2.5 WHEN 'admin' THEN 1.0 ELSE 0.5 END) AS weight FROM @F GROUP BY slug, path",
    "a27_dependence": "SELECT count(*) AS keys, count(*) FILTER (WHERE sources = 1) AS single, round(avg(sources), 9) AS mean, (SELECT message FROM (SELECT message, count(*) AS n FROM @F WHERE cls IS NOT NULL AND message IS NOT NULL GROUP BY message) AS m ORDER BY n DESC, message LIMIT 1) AS message FROM (SELECT slug, path, line, cls, count(DISTINCT source) AS sources FROM @F WHERE cls IS NOT NULL GROUP BY slug, path, line, cls) AS x",
    "k02_enumerated": "SELECT finding_id, row_number() OVER (PARTITION BY run_uid, tool ORDER BY rank NULLS FIRST, finding_id) AS n FROM @F",
    "k07_severity": "SELECT finding_id, row_number() OVER (PARTITION BY rkey, tool ORDER BY CASE WHEN conf >= 0.7 THEN 3 WHEN conf >= 0.5 THEN 2 ELSE 1 END DESC, rank NULLS FIRST, finding_id) AS n FROM @F",
    "k10_best_weight": "WITH y AS (SELECT k.finding_id, k.tool, w.flow, row_number() OVER (PARTITION BY w.flow, k.rkey, k.tool ORDER BY round(k.score + (w.flow - 1) * coalesce(k.conf, 0.6), 6) DESC, k.rank NULLS FIRST, k.finding_id) AS n FROM @RK k CROSS JOIN (VALUES (0), (1), (2), (4)) AS w(flow)), t AS (SELECT flow, tool, count(*) AS lists, count(*) FILTER (WHERE finding_id IN (SELECT finding_id FROM @GEO WHERE in_file)) AS hits FROM y WHERE n = 1 GROUP BY flow, tool), z AS (SELECT flow, CAST(sum(hits) AS BIGINT) AS hits, round(avg(hits * 1.0 / lists), 9) AS macro FROM t GROUP BY flow) SELECT flow, hits FROM z WHERE macro >= (SELECT macro FROM z WHERE flow = 1) ORDER BY hits DESC, flow DESC LIMIT 1",
    "k11_tier_sweep": "SELECT w, count(*) FILTER (WHERE tier = 3) AS strong_first FROM (SELECT w.w, t.tier, row_number() OVER (PARTITION BY w.w, t.rkey, t.tool ORDER BY round(t.score + w.w * t.tier, 6) DESC, t.rank NULLS FIRST, t.finding_id) AS n FROM (SELECT *, CASE WHEN cls IN ('csrf', 'auth') OR coalesce(conf, 0.6) <= 0.45 THEN 1 WHEN lower(sink) LIKE '%wpdb%' THEN 3 ELSE 2 END AS tier FROM @RK) AS t JOIN (SELECT 0 AS w UNION ALL SELECT 1 UNION ALL SELECT 2) AS w ON true) AS x WHERE n = 1 GROUP BY w",
    "x07_class_score": "SELECT k.tool, k.cls, count(DISTINCT k.rkey) AS records, count(DISTINCT CASE WHEN g.in_file AND k.rk <= 10 THEN k.rkey END) AS file_10, count(DISTINCT CASE WHEN g.distance <= 5 AND k.rk <= 10 THEN k.rkey END) AS near_10 FROM @RK k JOIN @GEO g ON g.finding_id = k.finding_id WHERE k.cls IS NOT NULL GROUP BY k.tool, k.cls",
    "t18_cohorts": "SELECT early, count(*) AS records, round(avg(hit), 9) AS rate FROM (SELECT rkey, cve < 'CVE-2034' AS early, max(CASE WHEN in_file THEN 1.0 ELSE 0.0 END) AS hit FROM @GEO WHERE cve IS NOT NULL GROUP BY rkey, cve < 'CVE-2034') AS x GROUP BY early",
    "t21_orders": "SELECT tool, rate, rank() OVER (ORDER BY rate DESC) AS place FROM (SELECT tool, round(avg(CASE WHEN in_file THEN 1.0 ELSE 0.0 END), 9) AS rate FROM @GEO GROUP BY tool) AS x",
    "t22_line_arms": "SELECT arm, tool, count(*) AS n, count(*) FILTER (WHERE distance = 0) AS exact FROM (SELECT 'all' AS arm, tool, distance FROM @GEO UNION ALL SELECT 'anchored', tool, distance FROM @GEO WHERE distance IS NOT NULL UNION ALL SELECT 'in file', tool, distance FROM @GEO WHERE in_file UNION ALL SELECT 'in callable', tool, distance FROM @GEO WHERE (finding_id, gid) IN (SELECT (finding_id, gid) FROM @SC) UNION ALL SELECT 'modified', tool, distance FROM @GEO WHERE in_file AND distance >= 0) AS x GROUP BY arm, tool",
    "t25_completed_pairs": "SELECT count(*) AS records, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, count(*) FILTER (WHERE a > b) AS only_a, count(*) FILTER (WHERE a < b) AS only_b FROM (SELECT rkey, max(CASE WHEN tool = 'wpt' AND in_file THEN 1 ELSE 0 END) AS a, max(CASE WHEN tool = 'progpilot' AND in_file THEN 1 ELSE 0 END) AS b FROM @GEO GROUP BY rkey HAVING count(DISTINCT CASE WHEN tool IN ('wpt', 'progpilot') AND conf IS NOT NULL THEN tool END) = 2) AS x",
    "q01_host_failures": "SELECT count(*) AS releases, CAST(sum(zip_errors) AS BIGINT) AS errors, coalesce(sum(zip_errors) * 1.0 / sum(zips), 0.0) > 0.01 AS refused FROM parser_coverage",
    "q04_distinct_reasons": "SELECT tool, count(DISTINCT message) AS reasons, count(*) AS n, round(count(DISTINCT message) * 1.0 / count(*), 9) AS ratio FROM @F GROUP BY tool",
    "q07_reconciled": "SELECT slug, path, line, CASE WHEN a = b THEN a ELSE c END AS cls FROM (SELECT slug, path, line, min(CASE WHEN tool = 'wpt' THEN cls END) AS a, min(CASE WHEN tool = 'progpilot' THEN cls END) AS b, min(CASE WHEN tool = 'semgrep' THEN cls END) AS c FROM @F GROUP BY slug, path, line) AS x WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL",
    "q08_totals": "SELECT 'tool' AS by, CAST(sum(n) AS BIGINT) AS derived, (SELECT count(DISTINCT finding_id) FROM findings) AS published, sum(n) = (SELECT count(DISTINCT finding_id) FROM findings) AS agrees FROM (SELECT tool, count(*) AS n FROM @F GROUP BY tool) AS a UNION ALL SELECT 'cls', CAST(sum(n) AS BIGINT), (SELECT count(DISTINCT finding_id) FROM findings), sum(n) = (SELECT count(DISTINCT finding_id) FROM findings) FROM (SELECT cls, count(*) AS n FROM @F GROUP BY cls) AS b UNION ALL SELECT 'slug', CAST(sum(n) AS BIGINT), (SELECT count(DISTINCT finding_id) FROM findings), sum(n) = (SELECT count(DISTINCT finding_id) FROM findings) FROM (SELECT slug, count(*) AS n FROM @F GROUP BY slug) AS d",
    "q10_stamp": "SELECT run_uid, tool, count(*) AS findings, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan FROM @F GROUP BY run_uid, tool",
    "q13_same_records": "SELECT a.tool AS a, b.tool AS b, count(*) AS shared FROM (SELECT DISTINCT tool, rkey FROM @F) AS a JOIN (SELECT DISTINCT tool, rkey FROM @F) AS b ON a.rkey = b.rkey AND a.tool < b.tool GROUP BY a.tool, b.tool",
}


def duck(name: str) -> str:
    """The same report for DuckDB, with the base tables it needs in front."""
    sql = REPORTS[name]
    need = set(re.findall(r"@([A-Z]+)", sql))
    while more := {x for k in need for x in NEEDS.get(k, [])} - need:
        need |= more
    body = re.sub(r"@([A-Z]+)", r"\1", sql).replace("\\\\_", "\\_")
    body = re.sub(r"LIKE ('[^']*\\_[^']*')", r"LIKE \1 ESCAPE '\\'", body)
    heads = ", ".join(f"{k} AS ({BASE[k]})" for k in ORDER if k in need)
    return f"WITH {heads} SELECT * FROM ({body})" if heads else body
