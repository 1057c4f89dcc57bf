"""Queries built from the DataFrame operators, each with an independent statement in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.keys import slug_key
from plumbline.operators import findings as base
from plumbline.operators import graphs, statistics
from plumbline.operators.geometry import geometry, violations
from plumbline.operators.rank import even_rank, mid_ranks
from plumbline.plans.base_sql import BASE, ORDER, SLUG
from plumbline.sources.tables import table

REPLICATES = 10_000
TOP_K = 3
_DRAW = "CAST(('0x' || substr(md5({0}), 1, 15)) AS BIGINT)"


def _geo(spark: SparkSession, folder: str) -> DataFrame:
    return geometry(base.findings(spark, folder), base.patches(spark, folder))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the number of tools' hits: a for the first tool, b for the second; a missing tool counts 0."""
    hit = lambda tool: F.max(F.when((F.col("tool") == tool) & F.col("in_file"), 1).otherwise(0))
    return _geo(spark, folder).groupBy("slug", "rkey").agg(hit("wpt").alias("a"), hit("progpilot").alias("b"))


def with_bases(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({BASE[k]})" for k in ORDER if k in names) + f" SELECT * FROM ({sql})"


GEO = ("F", "G", "CL", "BD", "HK", "GEO")
HITS = "SELECT slug, rkey, max(CASE WHEN tool = 'wpt' AND in_file THEN 1 ELSE 0 END) AS a, max(CASE WHEN tool = 'progpilot' AND in_file THEN 1 ELSE 0 END) AS b FROM GEO GROUP BY slug, rkey"
SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT record_id, {SLUG.format('slug')} AS slug FROM plugins WHERE slug IS NOT NULL")
def s02_slugs(spark, folder):
    return table(spark, folder, "plugins").where("slug IS NOT NULL").select("record_id", slug_key("slug").alias("slug"))


@query(r"""SELECT file_id, trim(regexp_extract(h, '(?im)^[ \t/*#@]*Plugin Name:[ \t]*([^\r\n]+)', 1)) AS name, trim(regexp_extract(h, '(?im)^[ \t/*#@]*Version:[ \t]*([^\r\n]+)', 1)) AS version
FROM (SELECT file_id, substr(content, 1, 4096) AS h FROM source_files WHERE content IS NOT NULL) WHERE regexp_matches(h, '(?im)^[ \t/*#@]*Plugin Name:')""")
def s03_headers(spark, folder):
    """Plugin name and version from the first 4096 characters of files."""
    rows = table(spark, folder, "source_files", "file_id", "content").where("content IS NOT NULL").select("file_id", F.substring("content", 1, 4096).alias("h"))
    return rows.where(F.col("h").rlike(text.HEADER_NAME)).select("file_id", text.header("h", "Plugin Name").alias("name"), text.header("h", "Version").alias("version"))


@query("SELECT file_id, sha256(content) AS hash FROM source_files WHERE content IS NOT NULL")
def s18_hashes(spark, folder):
    return table(spark, folder, "source_files", "file_id", "content").where("content IS NOT NULL").select("file_id", F.sha2("content", 256).alias("hash"))


@query("SELECT vuln_class AS label, CASE WHEN vuln_class = 'SQL Injection' THEN 'sqli' WHEN vuln_class = 'Cross Site Request Forgery (CSRF)' THEN 'csrf' WHEN vuln_class = 'Cross Site Scripting (XSS)' THEN 'xss' WHEN vuln_class IN ('PHP Object Injection', 'Deserialization of untrusted data') THEN 'deserial' WHEN vuln_class IN ('Remote Code Execution (RCE)', 'Arbitrary Code Execution') THEN 'rce' WHEN vuln_class IN ('Broken Access Control', 'Broken Authentication', 'Privilege Escalation', 'Bypass Vulnerability', 'Insecure Direct Object References (IDOR)') THEN 'auth' WHEN vuln_class IN ('Local File Inclusion', 'Path Traversal', 'Arbitrary File Download') THEN 'lfi' WHEN vuln_class = 'Server Side Request Forgery (SSRF)' THEN 'ssrf' WHEN vuln_class = 'Arbitrary File Upload' THEN 'upload' WHEN vuln_class IN ('Sensitive Data Exposure', 'CSV Injection', 'Arbitrary File Deletion', 'Multiple Vulnerabilities') THEN 'other' WHEN lower(vuln_class) LIKE '%sql%' THEN 'sqli' WHEN lower(vuln_class) LIKE '%object injection%' OR lower(vuln_class) LIKE '%deserial%' THEN 'deserial' WHEN lower(vuln_class) LIKE '%cross-site request forgery%' OR lower(vuln_class) LIKE '%cross site request forgery%' OR lower(vuln_class) LIKE '%csrf%' THEN 'csrf' WHEN lower(vuln_class) LIKE '%server side request forgery%' OR lower(vuln_class) LIKE '%server-side request forgery%' OR lower(vuln_class) LIKE '%ssrf%' THEN 'ssrf' WHEN lower(vuln_class) LIKE '%cross-site scripting%' OR lower(vuln_class) LIKE '%cross site scripting%' OR lower(vuln_class) LIKE '%xss%' OR lower(vuln_class) LIKE '%web page generation%' THEN 'xss' WHEN lower(vuln_class) LIKE '%broken access%' OR lower(vuln_class) LIKE '%authentication%' OR lower(vuln_class) LIKE '%privilege%' OR lower(vuln_class) LIKE '%bypass%' OR lower(vuln_class) LIKE '%idor%' OR lower(vuln_class) LIKE '%insecure direct object%' OR lower(vuln_class) LIKE '%authorization%' THEN 'auth' WHEN lower(vuln_class) LIKE '%upload%' THEN 'upload' WHEN lower(vuln_class) LIKE '%path traversal%' OR lower(vuln_class) LIKE '%directory traversal%' OR lower(vuln_class) LIKE '%file download%' OR lower(vuln_class) LIKE '%file inclusion%' OR lower(vuln_class) LIKE '%lfi%' THEN 'lfi' WHEN lower(vuln_class) LIKE '%remote code execution%' OR lower(vuln_class) LIKE '%arbitrary code%' OR lower(vuln_class) LIKE '%command injection%' OR lower(vuln_class) LIKE '%code injection%' OR lower(vuln_class) LIKE '%rce%' THEN 'rce' ELSE 'other' END AS cls, count(*) AS n FROM findings WHERE vuln_class IS NOT NULL GROUP BY 1, 2")
def s10_types(spark, folder):
    """Advisory labels to classes: exact names first, then the first phrase that occurs."""
    rows = table(spark, folder, "findings", "vuln_class").where("vuln_class IS NOT NULL")
    return rows.groupBy(F.col("vuln_class").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("cls", text.advisory_class("label"))


@query("SELECT message, CASE WHEN lower(message) LIKE '%sql%' THEN 'sqli' WHEN lower(message) LIKE '%xss%' OR lower(message) LIKE '%cross-site-scripting%' THEN 'xss' WHEN lower(message) LIKE '%lfi%' OR lower(message) LIKE '%rfi%' OR lower(message) LIKE '%file-inclusion%' OR lower(message) LIKE '%path-traversal%' OR lower(message) LIKE '%tainted-filename%' OR lower(message) LIKE '%include%' OR lower(message) LIKE '%require%' THEN 'lfi' WHEN lower(message) LIKE '%rce%' OR lower(message) LIKE '%code-execution%' OR lower(message) LIKE '%command-injection%' OR lower(message) LIKE '%eval%' OR lower(message) LIKE '%tainted-exec%' OR lower(message) LIKE '%os-command%' OR lower(message) LIKE '%system%' THEN 'rce' WHEN lower(message) LIKE '%deserial%' OR lower(message) LIKE '%unserialize%' OR lower(message) LIKE '%object-injection%' THEN 'deserial' WHEN lower(message) LIKE '%ssrf%' THEN 'ssrf' WHEN lower(message) LIKE '%upload%' THEN 'upload' WHEN lower(message) LIKE '%auth%' OR lower(message) LIKE '%access-control%' OR lower(message) LIKE '%capability%' OR lower(message) LIKE '%privilege%' OR lower(message) LIKE '%nonce-missing%' THEN 'auth' WHEN lower(message) LIKE '%csrf%' OR lower(message) LIKE '%nonce%' THEN 'csrf' ELSE 'other' END AS cls, count(*) AS n FROM findings WHERE message IS NOT NULL GROUP BY 1, 2")
def s11_tool_labels(spark, folder):
    rows = table(spark, folder, "findings", "message").where("message IS NOT NULL").groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("cls", text.tool_class("message"))


@query(with_bases("SELECT slug, string_agg(cls, ',' ORDER BY cls) AS classes FROM (SELECT DISTINCT slug, cls FROM F WHERE cls IS NOT NULL) GROUP BY slug", "F"))
def s15_truth(spark, folder):
    rows = base.findings(spark, folder).where("cls IS NOT NULL")
    return rows.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"))


@query("SELECT path, regexp_replace(path, '^[^/]+/(.)', '\\1') AS below, trim(replace(lower(path), chr(92), '/'), '/') AS key FROM source_files")
def f05_paths(spark, folder):
    from plumbline.functions.keys import path_key, strip_top

    return table(spark, folder, "source_files", "path").select("path", strip_top("path").alias("below"), path_key("path").alias("key"))


_LETTER = r"\p{L}\p{N}_"
_TOOLS = rf"(?i)(^|[^{_LETTER}])(semgrep|progpilot|wp[-_ ]?taint|taint[-_ ]?scan|wpt)($|[^{_LETTER}])"
_RULE = rf"regexp_matches(t, '^[{_LETTER}-]+(\.[{_LETTER}-]+){{{{2,}}}}$') OR regexp_matches(t, '(?i)(^|[^{_LETTER}])(php\.lang|php\.security|semgrep|progpilot)($|[^{_LETTER}])|(^|[^{_LETTER}])generic\.[{_LETTER}]')".replace("{{", "{").replace("}}", "}")


@query(f"""SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '{_TOOLS}', '\\1[tool]\\3', 'g'), '{_TOOLS}', '\\1[tool]\\3', 'g'), ' '), lambda t: CASE WHEN {_RULE} THEN '[rule]' ELSE t END), ' ') AS text FROM documents WHERE text IS NOT NULL""")
def f16_scrubbed(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", text.scrub("text").alias("text"))


@query("SELECT finding_id, sink, CASE WHEN trim(sink) = '' THEN '' WHEN regexp_matches(trim(sink), '^[\\p{L}\\p{N}_-]+(\\.[\\p{L}\\p{N}_-]+){2,}$') THEN '(sink category: ' || trim(translate(string_split(trim(sink), '.')[-1], '-_', '  ')) || ')' ELSE sink END AS neutral FROM (SELECT finding_id, min(sink) AS sink FROM findings WHERE sink IS NOT NULL GROUP BY finding_id)")
def f16_sinks(spark, folder):
    """Sinks without what tells the tool."""
    rows = table(spark, folder, "findings", "finding_id", "sink").where("sink IS NOT NULL").groupBy("finding_id").agg(F.min("sink").alias("sink"))
    return rows.select("finding_id", "sink", text.neutral_sink("sink").alias("neutral"))


@query(with_bases("SELECT finding_id, sha256(concat_ws('|', rkey, tool, path, coalesce(CAST(line AS VARCHAR), ''), coalesce(cls, ''), CAST(row_number() OVER (PARTITION BY rkey, tool, path, line, cls ORDER BY finding_id) - 1 AS VARCHAR))) AS uid FROM F", "F"))
def f26_identifiers(spark, folder):
    rows = base.findings(spark, folder)
    n = F.row_number().over(Window.partitionBy("rkey", "tool", "path", "line", "cls").orderBy("finding_id")) - 1
    parts = ["rkey", "tool", "path", F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("cls", F.lit("")), n.cast("string")]
    return rows.withColumn("uid", F.sha2(F.concat_ws("|", *parts), 256)).select("finding_id", "uid")


@query("SELECT finding_id, row_number() OVER (ORDER BY sha256('20260717|' || finding_uid), finding_id) AS place FROM (SELECT finding_id, min(finding_uid) AS finding_uid FROM findings GROUP BY finding_id)")
def f29_permutation(spark, folder):
    """All findings numbered in the order of a seeded hash: a shuffle without a generator."""
    rows = table(spark, folder, "findings", "finding_id", "finding_uid").groupBy("finding_id").agg(F.min("finding_uid").alias("finding_uid"))
    hashed = rows.select("finding_id", F.sha2(F.concat_ws("|", F.lit("20260717"), "finding_uid"), 256).alias("h"))
    return even_rank(hashed, [], [F.col("h"), F.col("finding_id")], "place").select("finding_id", "place")


def _marked(column: str, kind: str) -> str:
    """How a value is written for the mark, in DuckDB's SQL: its length, a colon and its text; ``~`` for null."""
    text_of = {"double": "lower(CAST({0} AS VARCHAR))", "ts": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "list": "array_to_string(list_transform({0}, lambda x: coalesce(length(x) || ':' || x, '~')), '')"}
    value = text_of.get(kind, "CAST({0} AS VARCHAR)").format(f'"{column}"')
    return f"coalesce(length({value}) || ':' || {value}, '~')"


_KINDS = {"confidence": "double", "guard_deficit": "double", "ingested_at": "ts", "scanned_at": "ts", "trace": "list"}
_COLUMNS = "confidence cve entry_point file finding_id finding_uid function guard_deficit ingested_at interprocedural line message rank run_uid scanned_at sink slug source tool trace vuln_class".split()
_ROW = " || ".join(_marked(c, _KINDS.get(c, "")) for c in _COLUMNS)
_SUMS = " || '|' || ".join(f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {i}, 16) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR)" for i in (1, 17, 33, 49))


@query(with_bases(f"""SELECT count(*) AS n, count(DISTINCT rkey) AS records, count(*) FILTER (WHERE rank <= {TOP_K}) AS n_topk,
 (SELECT sha256(count(*) || '|' || {_SUMS}) FROM (SELECT sha256({_ROW}) AS h FROM findings)) AS mark FROM F""", "F"))
def q12_fingerprint(spark, folder):
    """What an analysis was computed over: findings, records, findings at top k, and a mark of every column of every delivered row.

    A row's columns are written one behind the other, each with its length, and hashed by SHA-256; the hashes' four
    64-bit parts are summed up apart, so the mark depends on no order, but on how often a row occurs.
    """
    n = base.findings(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rkey").alias("records"), F.count_if(F.col("rank") <= TOP_K).alias("n_topk"))
    raw = table(spark, folder, "findings")
    written = lambda v: F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~"))
    forms = {
        "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "double": lambda c: F.lower(c.cast("string")), "array<string>": lambda c: F.array_join(F.transform(c, written), ""),
    }
    h = raw.select(F.sha2(F.concat(*[written(forms.get(kind, lambda c: c.cast("string"))(F.col(c))) for c, kind in sorted(raw.dtypes)]), 256).alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", i, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in (1, 17, 33, 49)]
    return n.crossJoin(h.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("mark")))


@query("SELECT n, pow(0.5, n) * 2 AS floor FROM range(1, 21) t(n)")
def f31_power_floor(spark, folder):
    return spark.range(1, 21).select(F.col("id").alias("n"), (F.pow(F.lit(0.5), "id") * 2).alias("floor"))


_BROKEN = " UNION ALL ".join(
    f"SELECT finding_id, gid, '{a} without {b}' AS rule FROM R WHERE {a} AND NOT {b}"
    for a, b in (("exact", "in_file"), ("same_callable", "in_file"), ("in_hunk", "in_file"), ("within2", "in_file"), ("within5", "in_file"), ("within10", "in_file"), ("exact", "within2"), ("within2", "within5"), ("within5", "within10")))
_ROWS = "WITH R AS (SELECT g.finding_id, g.gid, {0} AS in_file, coalesce(distance = 0, false) AS exact, coalesce(distance <= 2, false) AS within2, {1} AS within5, coalesce(distance <= 10, false) AS within10, in_hunk, s.gid IS NOT NULL AS same_callable FROM GEO g LEFT JOIN SC s ON s.finding_id = g.finding_id AND s.gid = g.gid) "


@query(with_bases(_ROWS.format("in_file AND g.finding_id % 3 <> 0", "coalesce(distance <= 5, false) AND g.finding_id % 5 <> 0") + _BROKEN, *GEO, "RG", "SC"))
def x06_noticed(spark, folder):
    """The same check on geometry that was damaged on purpose: every third finding's file and every fifth one's proximity is taken away."""
    bad = _geo(spark, folder).withColumns({"in_file": F.col("in_file") & (F.col("finding_id") % 3 != 0), "within5": F.col("within5") & (F.col("finding_id") % 5 != 0)})
    return violations(bad)


@query(with_bases(_ROWS.format("in_file", "coalesce(distance <= 5, false)") + _BROKEN, *GEO, "RG", "SC"))
def x06_violations(spark, folder):
    """Broken implications between rungs: none."""
    return violations(_geo(spark, folder))


@query(with_bases(f"SELECT finding_id, gid FROM (SELECT g.finding_id, g.gid, c.line AS c, (SELECT first(struct_pack(s := r.s, e := r.e) ORDER BY r.e - r.s, r.s) FROM RG r WHERE r.gid = g.gid AND g.line BETWEEN r.s AND r.e) AS own, (SELECT first(struct_pack(s := r.s, e := r.e) ORDER BY r.e - r.s, r.s) FROM RG r WHERE r.gid = g.gid AND c.line BETWEEN r.s AND r.e) AS other FROM GEO g JOIN CL c ON c.gid = g.gid WHERE g.line > 0) WHERE own IS NOT DISTINCT FROM other GROUP BY finding_id, gid", *GEO, "RG"))
def j15_same_callable(spark, folder):
    return _geo(spark, folder).where("same_callable").select("finding_id", "gid").distinct()


def _boot(spark, folder, value, measures):
    hits = _hits(spark, folder)
    sums = statistics.clusters(hits, "slug", measures)
    return statistics.interval(statistics.resampled(sums, list(measures), REPLICATES, 42), value)


_BOOT = f"""SELECT round(quantile_cont(v, 0.025), 9) AS value_low, round(quantile_cont(v, 0.975), 9) AS value_high, count(v) AS defined, count(*) - count(v) AS undefined,
 round(least(1.0, 2 * least(avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END))), 9) AS p FROM (
 SELECT {{0}} AS v FROM (SELECT slug, count(*) AS n, sum(a) AS a, sum(b) AS b, row_number() OVER (ORDER BY slug) - 1 AS i FROM ({HITS}) GROUP BY slug) c
 JOIN (SELECT rep, {_DRAW.format("'42|' || rep || '|' || slot")} % k AS i FROM (SELECT count(DISTINCT slug) AS k FROM GEO), range(0, {REPLICATES}) r(rep), LATERAL (SELECT unnest(range(0, k)) AS slot)) d USING (i) GROUP BY rep)"""


@query(with_bases(_BOOT.format("sum(a) * 1.0 / sum(n)"), *GEO))
def t01_rate_interval(spark, folder):
    """Cluster bootstrap of the first tool's success rate."""
    return _boot(spark, folder, F.col("a") / F.col("n"), {"a": F.col("a"), "b": F.col("b")})


@query(with_bases(_BOOT.format("sum(a) * 1.0 / sum(n) - sum(b) * 1.0 / sum(n)"), *GEO))
def t02_paired_difference(spark, folder):
    """The same draws for both tools: interval and p of their difference."""
    return _boot(spark, folder, F.col("a") / F.col("n") - F.col("b") / F.col("n"), {"a": F.col("a"), "b": F.col("b")})


@query(with_bases(_BOOT.format("sum(a) * 1.0 / nullif(sum(b), 0)"), *GEO))
def t05_paired_ratio(spark, folder):
    """Ratio of both tools' hits; replicates without a denominator are dropped and counted."""
    return _boot(spark, folder, F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), {"a": F.col("a"), "b": F.col("b")})


@query(with_bases(f"""WITH RECURSIVE h AS ({HITS}), t AS (SELECT count(*) FILTER (WHERE a > b) AS b_only, count(*) FILTER (WHERE b > a) AS c_only FROM h),
 w(i, term, s) AS (SELECT 0, pow(0.5, b_only + c_only), pow(0.5, b_only + c_only) FROM t UNION ALL SELECT i + 1, term * (b_only + c_only - i) / (i + 1), s + term * (b_only + c_only - i) / (i + 1) FROM w, t WHERE i < least(b_only, c_only))
 SELECT b_only, c_only, round(CASE WHEN b_only + c_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT s FROM w ORDER BY i DESC LIMIT 1)) END, 12) AS p FROM t""", *GEO))
def t09_mcnemar(spark, folder):
    """Exact McNemar test over records."""
    n = _hits(spark, folder).agg(F.count_if(F.col("a") > F.col("b")).alias("b_only"), F.count_if(F.col("b") > F.col("a")).alias("c_only"))
    return n.withColumn("p", F.round(statistics.binomial_two_sided(F.col("b_only"), F.col("c_only")), 12))


@query(with_bases(f"""WITH RECURSIVE d AS (SELECT d, row_number() OVER (ORDER BY slug) AS i FROM (SELECT slug, sum(a) - sum(b) AS d FROM ({HITS}) GROUP BY slug HAVING sum(a) <> sum(b))), o AS (SELECT count(*) AS n, coalesce(CAST(sum(d) AS BIGINT), 0) AS observed FROM d),
 w(i, s) AS (SELECT 0, CAST(0 AS HUGEINT) UNION ALL SELECT w.i + 1, w.s + t.sign * d.d FROM w JOIN d ON d.i = w.i + 1, (VALUES (-1), (1)) AS t(sign))
 SELECT CAST(o.n AS BIGINT) AS n, o.observed, round(avg(CASE WHEN abs(w.s) >= abs(o.observed) THEN 1.0 ELSE 0.0 END), 12) AS p FROM w, o WHERE w.i = o.n GROUP BY ALL""", *GEO))
def t10_sign_flip(spark, folder):
    """Exact sign-flip test over plugins' differences."""
    return statistics.sign_flip(_hits(spark, folder).groupBy("slug").agg((F.sum("a") - F.sum("b")).alias("d")))


@query(with_bases(f"""WITH d AS (SELECT slug, sum(a) - sum(b) AS d FROM ({HITS}) GROUP BY slug HAVING sum(a) <> sum(b)),
 r AS (SELECT rep, sum(CASE WHEN {_DRAW.format("'7|' || rep || '|' || slug")} % 2 = 0 THEN d ELSE -d END) AS s FROM d, range(0, {REPLICATES}) x(rep) GROUP BY rep)
 SELECT CAST(coalesce((SELECT sum(d) FROM d), 0) AS BIGINT) AS observed, round((count(*) FILTER (WHERE abs(s) >= abs((SELECT sum(d) FROM d))) + 1) * 1.0 / ({REPLICATES} + 1), 9) AS p FROM r""", *GEO))
def t11_permutations(spark, folder):
    """Monte-Carlo sign flips, a sign being one bit of a hash."""
    d = _hits(spark, folder).groupBy("slug").agg((F.sum("a") - F.sum("b")).alias("d")).where("d <> 0")
    reps = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    sign = F.when(statistics.draw(F.lit("7"), F.col("rep"), F.col("slug")) % 2 == 0, 1).otherwise(-1)
    sums = reps.groupBy("rep").agg(F.sum(sign * F.col("d")).alias("s"), F.sum("d").alias("o"))
    return sums.agg(F.coalesce(F.max("o"), F.lit(0)).cast("long").alias("observed"), F.round((F.count_if(F.abs("s") >= F.abs("o")) + 1) / F.lit(REPLICATES + 1), 9).alias("p"))


@query(with_bases("""WITH q AS (SELECT cls, CAST(min(coalesce(conf, 1.0)) AS DOUBLE) / 50 AS p FROM F WHERE cls IS NOT NULL GROUP BY cls), r AS (SELECT cls, p, row_number() OVER (ORDER BY p, cls) AS i, count(*) OVER () AS m FROM q)
 SELECT cls, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, cls ROWS UNBOUNDED PRECEDING), 12) AS holm FROM r""", "F"))
def t12_holm(spark, folder):
    """Holm's correction over one p for each class."""
    p = base.findings(spark, folder).where("cls IS NOT NULL").groupBy("cls").agg((F.min(F.coalesce("conf", F.lit(1.0))) / 50).alias("p"))
    return statistics.holm(p, "p", ["cls"])


@query(with_bases("""WITH s AS (SELECT cls, count(*) AS size FROM F WHERE cls IS NOT NULL GROUP BY cls), k AS (SELECT count(*) AS k, CAST(sum(size) AS BIGINT) AS total FROM s), q AS (SELECT cls, size, (size - 1) * 1.0 / greatest(total - k, 1) * (200 - k) AS share FROM s, k)
 SELECT cls, size, least(size, 1 + CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, cls) <= 200 - count(*) OVER () - sum(floor(share)) OVER () THEN 1 ELSE 0 END) AS take FROM q""", "F"))
def set_allocation(spark, folder):
    """200 places dealt to the classes in proportion, each at least one, the rest by largest remainders."""
    sizes = base.findings(spark, folder).where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    return statistics.allocate(sizes, "size", 200, ["cls"])


_EDGES = "SELECT DISTINCT lower(slug) AS child, lower(renamed_from) AS parent FROM plugins WHERE renamed_from IS NOT NULL AND lower(slug) <> lower(renamed_from)"


@query(with_bases("SELECT finding_id, rkey, tool, score, rk FROM RK", "F", "RK"))
def k01_ranked(spark, folder):
    """Every finding's place in its record's and tool's ranking."""
    rows = base.findings(spark, folder).select("finding_id", "rkey", "tool", "rank", "ep", "inter", "conf", "deficit")
    return base.ranked(rows, even=True).select("finding_id", "rkey", "tool", "score", "rk")


@query(with_bases("SELECT finding_id, rank() OVER (PARTITION BY tool ORDER BY conf) + (count(*) OVER (PARTITION BY tool, conf) - 1) / 2.0 AS mid_rank FROM F WHERE conf IS NOT NULL", "F"))
def k16_mid_ranks(spark, folder):
    rows = base.findings(spark, folder).where("conf IS NOT NULL").select("finding_id", "tool", "conf")
    return mid_ranks(rows, ["tool"], "conf", "mid_rank").select("finding_id", "mid_rank")


@query(with_bases("SELECT tool, max(CASE WHEN i = CAST(floor(0.9 * n) AS BIGINT) + 1 THEN line END) AS q90 FROM (SELECT tool, line, row_number() OVER (PARTITION BY tool ORDER BY line, finding_id) AS i, count(*) OVER (PARTITION BY tool) AS n FROM F WHERE line IS NOT NULL) AS x GROUP BY tool", "F"))
def k18_index_quantile(spark, folder):
    """The line at index floor(0.9 n) of each tool's sorted lines."""
    rows = base.findings(spark, folder).where("line IS NOT NULL").select("finding_id", "tool", "line")
    placed = even_rank(rows, ["tool"], [F.col("line"), F.col("finding_id")], "i")
    sizes = rows.groupBy("tool").agg((F.floor(0.9 * F.count(F.lit(1))) + 1).alias("at"))
    return placed.join(sizes, "tool").groupBy("tool").agg(F.max(F.when(F.col("i") == F.col("at"), F.col("line"))).alias("q90"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON w.ancestor = e.child WHERE w.depth < 64)
 SELECT node, ancestor, min(depth) AS depth FROM w WHERE node <> ancestor GROUP BY node, ancestor""")
def r01_closure(spark, folder):
    """All earlier names of each plugin, with how many renamings lie between."""
    edges = table(spark, folder, "plugins", "slug", "renamed_from").select(F.lower("slug").alias("child"), F.lower("renamed_from").alias("parent"))
    return graphs.closure(edges)[0]


@query(with_bases("""WITH RECURSIVE e AS (SELECT DISTINCT fn AS caller, sink AS callee FROM F WHERE fn IS NOT NULL AND sink IS NOT NULL UNION SELECT DISTINCT source, fn FROM F WHERE fn IS NOT NULL AND source IS NOT NULL),
 s AS (SELECT source AS node, min(CASE ep WHEN 'ajax_nopriv' THEN 1 WHEN 'ajax_auth' THEN 2 WHEN 'rest_api' THEN 3 WHEN 'shortcode' THEN 4 WHEN 'admin' THEN 5 ELSE 9 END) AS priority FROM F WHERE source IS NOT NULL GROUP BY source),
 w(node, priority, hops) AS (SELECT node, priority, 0 FROM s UNION SELECT e.callee, w.priority, w.hops + 1 FROM w JOIN e ON e.caller = w.node WHERE w.hops < 6)
 SELECT node, min(priority) AS priority FROM w GROUP BY node""", "F"))
def r05_reachability(spark, folder):
    """The strongest entry point from which each name is reached in at most six calls."""
    rows = base.findings(spark, folder)
    calls = rows.where("fn IS NOT NULL AND sink IS NOT NULL").select(F.col("fn").alias("caller"), F.col("sink").alias("callee")).union(rows.where("fn IS NOT NULL AND source IS NOT NULL").select("source", "fn"))
    starts = rows.where("source IS NOT NULL").select(F.col("source").alias("node"), base.keyed(base.ENTRY_PRIORITY, "ep", 9).alias("priority"))
    return graphs.reach(calls, starts)


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'signup' THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""")
def w01_strong_update(spark, folder):
    """Strong updates along a line of statements: the latest value written before or at each event."""
    written = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "signup", F.lit(0.0))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "events").select("user_id", "event_id", F.last(written, ignorenulls=True).over(w).alias("state"))
