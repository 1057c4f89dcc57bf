"""Studies over records: resampling of several measures, sweeps of weights, shapes of patches, changes between deliveries.

Every query has its own statement in SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.keys import path_key
from plumbline.operators import findings as base
from plumbline.operators import statistics
from plumbline.operators.geometry import rungs
from plumbline.plans.analyses import _DRAW, GEO, REPLICATES, with_bases
from plumbline.plans.frames import c, flag, found, ordered_hits, patched, placed, rate
from plumbline.sources.tables import table

SQL: dict[str, str] = {}
QUERIES: dict = {}
SHUFFLES = 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def advisory(rows: DataFrame) -> DataFrame:
    """(rkey, advised): the class most findings of a record have, the first by name of equally frequent ones."""
    n = rows.where("cls IS NOT NULL").groupBy("rkey", "cls").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("rkey").agg(F.min(F.struct(-c("n"), "cls")).alias("x")).select("rkey", c("x.cls").alias("advised"))


_ADVISED = "SELECT rkey, cls AS advised FROM (SELECT rkey, cls, row_number() OVER (PARTITION BY rkey ORDER BY count(*) DESC, cls) AS i FROM F WHERE cls IS NOT NULL GROUP BY rkey, cls) WHERE i = 1"


@query(with_bases(f"""SELECT g.finding_id, g.gid, coalesce(a.advised = g.cls, false) AS class_match, in_file AS geometric_file, s.gid IS NOT NULL AS geometric_callable, coalesce(distance = 0, false) AS geometric_exact_line, coalesce(distance <= 5, false) AS geometric_proximity_5,
 class_match AND in_file AS class_file, class_match AND s.gid IS NOT NULL AS class_callable, class_match AND coalesce(distance = 0, false) AS class_exact_line, class_match AND coalesce(distance <= 5, false) AS class_proximity_5
 FROM GEO g LEFT JOIN SC s ON s.finding_id = g.finding_id AND s.gid = g.gid LEFT JOIN ({_ADVISED}) a ON a.rkey = g.rkey""", *GEO, "RG", "SC"))
def x05_rungs(spark, folder):
    """Four rungs by place, and the same gated by the record's class."""
    rows = placed(spark, folder)
    return rungs(rows.join(advisory(found(spark, folder)), "rkey", "left"), "advised")


_ENDS = r"SELECT finding_id, trim(replace(lower(regexp_extract(t, '^.* @ (.*):([0-9]+)$', 1)), '\', '/'), '/') AS path, CAST(nullif(regexp_extract(t, '^.* @ (.*):([0-9]+)$', 2), '') AS INTEGER) AS line FROM (SELECT finding_id, unnest(trace) AS t FROM (SELECT finding_id, trace, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at NULLS FIRST, file NULLS FIRST, vuln_class NULLS FIRST) AS n FROM findings) WHERE n = 1)"


@query(with_bases(f"""SELECT f.finding_id, bool_or(g.gid IS NOT NULL) AS trace_file, bool_or(EXISTS (SELECT 1 FROM CL c WHERE c.gid = g.gid AND c.line BETWEEN e.line - 5 AND e.line + 5)) AS trace_near
 FROM F f JOIN (SELECT finding_id, path, line FROM F UNION ALL SELECT * FROM ({_ENDS}) WHERE path <> '') e ON e.finding_id = f.finding_id
 LEFT JOIN (SELECT g.*, s.raw FROM G g JOIN (SELECT DISTINCT slug AS raw, {{}} AS key FROM F) s ON s.key = g.slug WHERE coalesce(g.is_php, true)) g ON g.raw = f.slug AND g.cve IS NOT DISTINCT FROM f.cve AND g.path = e.path GROUP BY f.finding_id""".format(__import__("plumbline.plans.base_sql", fromlist=["SLUG"]).SLUG.format("slug")), "F", "G", "CL"))
def x08_trace_hits(spark, folder):
    """Whether a finding's own place or any place its trace names lies in a patched file, and near a change."""
    from plumbline.operators.geometry import geometry

    rows = found(spark, folder).select("finding_id", "slug", "cve", "path", "line")
    first = Window.partitionBy("finding_id").orderBy("ingested_at", "file", "vuln_class")
    raw = table(spark, folder, "findings", "finding_id", "trace", "ingested_at", "file", "vuln_class").withColumn("n", F.row_number().over(first)).where("n = 1").select("finding_id", F.explode("trace").alias("t"))
    part = lambda i: F.regexp_extract("t", r"^.* @ (.*):([0-9]+)$", i)
    ends = raw.select("finding_id", path_key(part(1)).alias("path"), F.nullif(part(2), F.lit("")).cast("int").alias("line")).where("path <> ''")
    ends = rows.select("finding_id", "slug", "cve").join(ends, "finding_id")
    both = geometry(rows.unionByName(ends), patched(spark, folder))
    return both.groupBy("finding_id").agg(F.bool_or("in_file").alias("trace_file"), F.bool_or("within5").alias("trace_near"))


@query(with_bases("""SELECT slug, cve, CASE WHEN n >= 20 THEN 'refactor-heavy' WHEN deleted > 0 AND added > 0 THEN 'rename' WHEN deleted > 0 THEN 'deletion' WHEN inserted > 0 THEN 'guard-insertion' ELSE 'code-replacement' END AS shape FROM
 (SELECT slug, cve, count(*) AS n, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'added') AS added,
  count(*) FILTER (WHERE status = 'modified' AND gid NOT IN (SELECT gid FROM CL)) AS inserted FROM G WHERE coalesce(is_php, true) GROUP BY slug, cve)""", "G", "CL"))
def f33_patch_shapes(spark, folder):
    """The shape of each advisory's patch, in the order of priority; a pair of a deleted and an added file counts as a renaming."""
    empty = F.coalesce(F.size(F.array_compact("changed_vuln_lines")), F.lit(0)) <= 0
    n = patched(spark, folder).where("coalesce(is_php, true)").groupBy("slug", "cve").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "deleted").alias("deleted"), F.count_if(c("status") == "added").alias("added"), F.count_if((c("status") == "modified") & empty).alias("inserted"))
    shape = F.when(c("n") >= 20, "refactor-heavy").when((c("deleted") > 0) & (c("added") > 0), "rename").when(c("deleted") > 0, "deletion").when(c("inserted") > 0, "guard-insertion").otherwise("code-replacement")
    return n.select("slug", "cve", shape.alias("shape"))


@query(with_bases("""SELECT gid, sha256('{"changed_vuln_lines":' || coalesce(CAST(to_json(changed_vuln_lines) AS VARCHAR), 'null') || ',"cve":' || coalesce('"' || cve || '"', 'null') || ',"path":"' || path || '","slug":' || coalesce('"' || slug || '"', 'null') || ',"status":"' || status || '"}') AS hash FROM G""", "G"))
def f28_patch_hashes(spark, folder):
    """Content hash of each patched file's record: keys in order, no blanks, nulls written."""
    from plumbline.functions.text import canonical_hash

    return patched(spark, folder).select("gid", canonical_hash("changed_vuln_lines", "cve", "path", "slug", "status").alias("hash"))


@query("SELECT alpha, CAST(ceil(log2(2 / alpha)) AS BIGINT) AS pairs FROM (VALUES (0.05), (0.01), (0.001), (0.0013)) AS t(alpha)")
def f31_pairs_needed(spark, folder):
    """The fewest discordant pairs whose extreme split reaches alpha: the first n with 2 x 0.5^n at most alpha."""
    alphas = spark.createDataFrame([(x,) for x in (0.05, 0.01, 0.001, 0.0013)], "alpha double")
    first = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(60)), lambda n: 2 * F.pow(F.lit(0.5), n) <= c("alpha")), 1)
    return alphas.select("alpha", first.cast("long").alias("pairs"))


def _measures(spark, folder) -> DataFrame:
    """One row for each record: first and third rank in a patched file for two tools, and findings in patched files and in all."""
    rows = ordered_hits(spark, folder)
    of = lambda t, k: F.max(flag((c("tool") == t) & c("in_file") & (c("rk") <= k)))
    part = lambda t: (F.count_if((c("tool") == t) & c("in_file")), F.count_if(c("tool") == t))
    return rows.groupBy("slug", "rkey").agg(
        of("wpt", 1).alias("a1"), of("wpt", 3).alias("a3"), part("wpt")[0].alias("ah"), part("wpt")[1].alias("an"),
        of("semgrep", 1).alias("b1"), of("semgrep", 3).alias("b3"), part("semgrep")[0].alias("bh"), part("semgrep")[1].alias("bn"))


_RECORDS = """SELECT k.slug, k.rkey, {0} FROM RK k JOIN GEO g ON g.finding_id = k.finding_id GROUP BY k.slug, k.rkey""".format(", ".join(
    f"max(CASE WHEN k.tool = '{t}' AND g.in_file AND k.rk <= 1 THEN 1 ELSE 0 END) AS {x}1, max(CASE WHEN k.tool = '{t}' AND g.in_file AND k.rk <= 3 THEN 1 ELSE 0 END) AS {x}3, count(*) FILTER (WHERE k.tool = '{t}' AND g.in_file) AS {x}h, count(*) FILTER (WHERE k.tool = '{t}') AS {x}n" for t, x in (("wpt", "a"), ("semgrep", "b"))))
_SUMS = "a1 a3 ah an b1 b3 bh bn".split()
_CLUSTERS = "SELECT {key}, count(*) AS n, " + ", ".join(f"sum({x}) AS {x}" for x in _SUMS) + ", row_number() OVER (ORDER BY {key}) - 1 AS i FROM ({rows}) GROUP BY {key}"
_REPS = "SELECT rep, sum(n) AS n, " + ", ".join(f"sum({x}) AS {x}" for x in _SUMS) + f""" FROM ({{clusters}}) c JOIN (SELECT rep, {_DRAW.format("'{seed}|' || rep || '|' || slot")} % k AS i FROM (SELECT count(*) AS k FROM ({{clusters}})), range(0, {REPLICATES}) r(rep), LATERAL (SELECT unnest(range(0, k)) AS slot)) d USING (i) GROUP BY rep"""
_SLUGS = _CLUSTERS.format(key="slug", rows=_RECORDS)


@query(with_bases("WITH x AS (" + _REPS.format(clusters=_SLUGS, seed=42) + """), v AS (SELECT 'success_1' AS metric, a1 * 1.0 / n - b1 * 1.0 / n AS v FROM x UNION ALL SELECT 'success_3', a3 * 1.0 / n - b3 * 1.0 / n FROM x UNION ALL SELECT 'precision', ah * 1.0 / nullif(an, 0) - bh * 1.0 / nullif(bn, 0) FROM x)
 SELECT metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(v) AS defined, count(v) < 0.9 * count(*) AS noted,
  CASE WHEN low > 0 OR high < 0 THEN 'excludes_zero_uncorrected' WHEN low >= -0.05 AND high <= 0.05 THEN 'within_margin' ELSE 'unresolved' END AS verdict FROM v GROUP BY metric""", *GEO, "RK"))
def t04_metrics(spark, folder):
    """Paired cluster bootstrap of several measures on the same draws; undefined replicates drop out, and a tenth of them is noted. Verdicts are told from the interval alone."""
    reps = statistics.resampled(statistics.clusters(_measures(spark, folder), "slug", {x: c(x) for x in _SUMS}), _SUMS, REPLICATES, 42)
    over = lambda a, b: c(a) / F.nullif(c(b), F.lit(0.0))
    values = {"success_1": over("a1", "n") - over("b1", "n"), "success_3": over("a3", "n") - over("b3", "n"), "precision": over("ah", "an") - over("bh", "bn")}
    long_ = reps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in values.items()])).alias("x")).select("x.*")
    ends = long_.groupBy("metric").agg(F.round(F.percentile("v", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 9).alias("high"), F.count("v").alias("defined"), (F.count("v") < 0.9 * F.count(F.lit(1))).alias("noted"))
    return ends.withColumn("verdict", statistics.verdict(c("low"), c("high"), 0.05))


@query(with_bases("WITH x AS (" + _REPS.format(clusters=_CLUSTERS.format(key="rkey", rows=_RECORDS), seed=17) + ") SELECT round(quantile_cont(a1 * 1.0 / n, 0.025), 9) AS low, round(quantile_cont(a1 * 1.0 / n, 0.975), 9) AS high FROM x", *GEO, "RK"))
def t17_record_bootstrap(spark, folder):
    """Bootstrap over single records, each its own cluster; a key that occurs twice is refused."""
    rows = statistics.unique(_measures(spark, folder), "rkey")
    reps = statistics.resampled(statistics.clusters(rows, "rkey", {x: c(x) for x in _SUMS}), _SUMS, REPLICATES, 17)
    return reps.agg(F.round(F.percentile(c("a1") / c("n"), F.lit(0.025)), 9).alias("low"), F.round(F.percentile(c("a1") / c("n"), F.lit(0.975)), 9).alias("high"))


_COHORT = "SELECT * FROM ({rows}) WHERE {cond}"
_EARLY = _CLUSTERS.format(key="slug", rows=_COHORT.format(rows=_RECORDS, cond="split_part(rkey, '|', 2) < 'CVE-2034' AND rkey LIKE '%|CVE%'"))
_LATE = _CLUSTERS.format(key="slug", rows=_COHORT.format(rows=_RECORDS, cond="split_part(rkey, '|', 2) >= 'CVE-2034'"))


@query(with_bases("WITH e AS (" + _REPS.format(clusters=_EARLY, seed=5) + "), l AS (" + _REPS.format(clusters=_LATE, seed=6) + ") SELECT round(quantile_cont(e.a1 * 1.0 / e.n - l.a1 * 1.0 / l.n, 0.025), 9) AS low, round(quantile_cont(e.a1 * 1.0 / e.n - l.a1 * 1.0 / l.n, 0.975), 9) AS high FROM e JOIN l USING (rep)", *GEO, "RK"))
def t18_cohort_difference(spark, folder):
    """Difference of two cohorts by year, each resampled by plugin on its own."""
    rows = _measures(spark, folder).withColumn("cve", F.split_part(c("rkey"), F.lit("|"), F.lit(2)))
    one = lambda cond, seed: statistics.resampled(statistics.clusters(rows.where(cond), "slug", {x: c(x) for x in _SUMS}), _SUMS, REPLICATES, seed).select("rep", (c("a1") / c("n")).alias(f"v{seed}"))
    both = one(c("cve").startswith("CVE") & (c("cve") < "CVE-2034"), 5).join(one(c("cve") >= "CVE-2034", 6), "rep")
    return both.agg(F.round(F.percentile(c("v5") - c("v6"), F.lit(0.025)), 9).alias("low"), F.round(F.percentile(c("v5") - c("v6"), F.lit(0.975)), 9).alias("high"))


_HEX = "regexp_replace(replace(lower(finding_uid), 'urn:uuid:', ''), '[^0-9a-f]', '', 'g')"
_STUDY = f"SELECT g.finding_id, g.finding_uid, g.slug, g.cls, g.tool, max(CASE WHEN in_file THEN 1 ELSE 0 END) AS hit FROM GEO g WHERE {_HEX.replace('finding_uid', 'g.finding_uid')} IN (SELECT {_HEX} FROM study_sample) AND cls IS NOT NULL GROUP BY ALL"


def _study(spark, folder) -> DataFrame:
    """Findings of the study's sample that have a class, with 1 where they lie in a patched file."""
    from plumbline.functions.keys import uuid_hex

    listed = table(spark, folder, "study_sample", "finding_uid").select(uuid_hex("finding_uid").alias("uid")).where("uid IS NOT NULL").distinct()
    rows = placed(spark, folder).where("cls IS NOT NULL").withColumn("uid", uuid_hex("finding_uid")).join(listed, "uid", "left_semi")
    return rows.groupBy("finding_id", "finding_uid", "slug", "cls", "tool").agg(F.max(flag(c("in_file"))).alias("hit"))


@query(with_bases(f"""WITH s AS ({_STUDY}), big AS (SELECT cls, tool, count(*) AS big FROM F WHERE cls IS NOT NULL GROUP BY cls, tool), cl AS (SELECT slug, row_number() OVER (ORDER BY slug) - 1 AS i FROM (SELECT DISTINCT slug FROM s)),
 d AS (SELECT rep, {_DRAW.format("'31|' || rep || '|' || slot")} % k AS i FROM (SELECT count(*) AS k FROM cl), range(0, {SHUFFLES}) r(rep), LATERAL (SELECT unnest(range(0, k)) AS slot)),
 cells AS (SELECT rep, cls, tool, sum(h) * 1.0 / sum(n) AS p FROM d JOIN cl USING (i) JOIN (SELECT slug, cls, tool, count(*) AS n, sum(hit) AS h FROM s GROUP BY slug, cls, tool) USING (slug) GROUP BY rep, cls, tool),
 v AS (SELECT rep, sum(big * p) / sum(big) AS v FROM cells JOIN big USING (cls, tool) GROUP BY rep)
 SELECT round((SELECT sum(big * p) / sum(big) FROM (SELECT cls, tool, avg(hit) AS p FROM s GROUP BY cls, tool) JOIN big USING (cls, tool)), 9) AS rate, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM v""", *GEO))
def t07_weighted_interval(spark, folder):
    """Rate of the study's sample, weighted by the population of its cells, with an interval: plugins are drawn, and each draw weighs the cells it covers."""
    s, key = _study(spark, folder), ["cls", "tool"]
    big = found(spark, folder).where("cls IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("big"))
    cells = s.groupBy("slug", *key).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    reps = statistics.drawn_clusters(s.select("slug").distinct(), "slug", SHUFFLES, 31)
    p = reps.join(cells, "slug").groupBy("rep", *key).agg((F.sum("h") / F.sum("n")).alias("p"))
    v = p.join(big, key).groupBy("rep").agg((F.sum(c("big") * c("p")) / F.sum("big")).alias("v"))
    ends = v.agg(F.round(F.percentile("v", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 9).alias("high"))
    point = s.groupBy(*key).agg(F.avg("hit").alias("p")).join(big, key).agg(F.round(F.sum(c("big") * c("p")) / F.sum("big"), 9).alias("rate"))
    return point.crossJoin(F.broadcast(ends))  # one row each


@query(with_bases(f"""WITH s AS (SELECT finding_uid, hit, row_number() OVER (ORDER BY md5('blind|' || finding_uid), finding_uid) - 1 AS pos FROM ({_STUDY})),
 m AS (SELECT -1 AS rep, hit, pos FROM s UNION ALL SELECT r.rep, hit, row_number() OVER (PARTITION BY r.rep ORDER BY md5(r.rep || '|' || finding_uid), finding_uid) - 1 FROM s, range(0, {SHUFFLES}) r(rep)),
 g AS (SELECT rep, abs(avg(pos) FILTER (WHERE hit = 1) - avg(pos) FILTER (WHERE hit = 0)) AS gap, count(*) FILTER (WHERE before IS NULL OR before <> hit) AS runs FROM (SELECT *, lag(hit) OVER (PARTITION BY rep ORDER BY pos) AS before FROM m) GROUP BY rep),
 o AS (SELECT gap, runs FROM g WHERE rep = -1)
 SELECT round(o.gap, 6) AS gap, o.runs, round(avg(CASE WHEN round(g.gap, 9) >= round(o.gap, 9) THEN 1.0 ELSE 0.0 END), 9) AS p_gap, round(avg(CASE WHEN g.runs <= o.runs THEN 1.0 ELSE 0.0 END), 9) AS p_runs FROM g, o WHERE g.rep >= 0 GROUP BY ALL""", *GEO))
def t20_independence(spark, folder):
    """Whether the blinded order of the study's sample tells hits: gap of mean positions and number of runs against shuffles by hashes.

    The sample is a table of a study's size; each shuffle of it is one group.
    """
    s = _study(spark, folder).select("finding_uid", "hit")
    many = s.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(SHUFFLES - 1))))
    key = F.md5(F.concat(F.when(c("rep") < 0, "blind").otherwise(c("rep").cast("string")), F.lit("|"), "finding_uid"))
    w = Window.partitionBy("rep").orderBy(key, "finding_uid")
    laid = many.withColumns({"pos": F.row_number().over(w) - 1, "before": F.lag("hit").over(w)})
    g = laid.groupBy("rep").agg(F.abs(F.avg(F.when(c("hit") == 1, c("pos"))) - F.avg(F.when(c("hit") == 0, c("pos")))).alias("g"), F.count_if(c("before").isNull() | (c("before") != c("hit"))).alias("r"))
    o = F.broadcast(g.where("rep = -1").select(c("g").alias("gap"), c("r").alias("runs")))  # one row
    both = g.where("rep >= 0").crossJoin(o)
    return both.groupBy(F.round("gap", 6).alias("gap"), "runs").agg(F.round(F.avg(flag(F.round("g", 9) >= F.round(c("gap"), 9))), 9).alias("p_gap"), F.round(F.avg(flag(c("r") <= c("runs"))), 9).alias("p_runs"))


_GRID = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0)


@query(with_bases(f"""WITH a AS ({_ADVISED}), h AS (SELECT finding_id, bool_or(in_file) AS hit FROM GEO GROUP BY finding_id),
 o AS (SELECT w.w, k.rkey, k.tool, row_number() OVER (PARTITION BY w.w, k.rkey, k.tool ORDER BY round(k.score + (w.w - 1) * coalesce(k.conf, 0.6), 6) DESC, k.rank NULLS FIRST, k.finding_id) AS n, h.hit, h.hit AND coalesce(k.cls = a.advised, false) AS right_
  FROM RK k JOIN h ON h.finding_id = k.finding_id LEFT JOIN a ON a.rkey = k.rkey CROSS JOIN (SELECT CAST(unnest([{", ".join(map(str, _GRID))}]) AS DOUBLE) AS w) w WHERE {_DRAW.format("'train|' || k.slug")} % 2 = 0),
 m AS (SELECT w, count(DISTINCT CASE WHEN right_ AND n <= 1 THEN rkey || '|' || tool END) AS cf1, count(DISTINCT CASE WHEN right_ AND n <= 3 THEN rkey || '|' || tool END) AS cf3, count(DISTINCT CASE WHEN hit AND n <= 1 THEN rkey || '|' || tool END) AS pf1 FROM o GROUP BY w)
 SELECT w, cf1, cf3, pf1, row_number() OVER (ORDER BY cf1 DESC, cf3 DESC, pf1 DESC, w) = 1 AS best FROM m""", *GEO, "RK"))
def k19_weight_sweep(spark, folder):
    """Seven weights of the flow's confidence on the training half of plugins: lists with the right class in a patched file at 1 and 3, any finding in one at 1; of equal weights the first is best."""
    rows = ordered_hits(spark, folder).where(statistics.draw(F.lit("train"), c("slug")) % 2 == 0)
    once = rows.groupBy("finding_id", "rkey", "tool", "cls", "score", "conf", "rank").agg(F.bool_or("in_file").alias("hit")).join(advisory(found(spark, folder)), "rkey", "left")
    many = once.withColumn("w", F.explode(F.array(*map(F.lit, _GRID))))
    by = Window.partitionBy("w", "rkey", "tool").orderBy(F.round(c("score") + (c("w") - 1) * F.coalesce("conf", F.lit(0.6)), 6).desc(), c("rank").asc_nulls_first(), "finding_id")
    right = c("hit") & F.coalesce(c("cls") == c("advised"), F.lit(False))
    lists = many.withColumn("n", F.row_number().over(by)).where("n <= 3").groupBy("w", "rkey", "tool").agg(F.max(flag(right & (c("n") == 1))).alias("cf1"), F.max(flag(right)).alias("cf3"), F.max(flag(c("hit") & (c("n") == 1))).alias("pf1"))
    m = lists.groupBy("w").agg(*[F.sum(x).alias(x) for x in ("cf1", "cf3", "pf1")])
    return m.withColumn("best", F.row_number().over(Window.orderBy(F.desc("cf1"), F.desc("cf3"), F.desc("pf1"), "w")) == 1)  # seven rows


_FIELDS = ("file", "vuln_class", "line", "tool", "slug", "cve", "confidence", "rank")
_ENDPOINTS = "SELECT finding_id, " + ", ".join(f"first({x} ORDER BY ingested_at NULLS FIRST, file NULLS FIRST, vuln_class NULLS FIRST) AS a_{x}, last({x} ORDER BY ingested_at NULLS FIRST, file NULLS FIRST, vuln_class NULLS FIRST) AS b_{x}" for x in _FIELDS) + " FROM findings GROUP BY finding_id"


@query("SELECT field, count(*) FILTER (WHERE differs) AS changed, field NOT IN ('file', 'vuln_class') AND count(*) FILTER (WHERE differs) > 0 AS outside FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS field, a_{x} IS DISTINCT FROM b_{x} AS differs FROM ({_ENDPOINTS})" for x in _FIELDS) + ") GROUP BY field")
def j27_field_changes(spark, folder):
    """Which fields differ between a finding's first and last delivery; only the spelling of files and labels may."""
    from plumbline.operators.diffs import field_changes

    raw = table(spark, folder, "findings")
    w = Window.partitionBy("finding_id")
    by = [c("ingested_at").asc_nulls_first(), c("file").asc_nulls_first(), c("vuln_class").asc_nulls_first()]
    back = [c("ingested_at").desc_nulls_last(), c("file").desc_nulls_last(), c("vuln_class").desc_nulls_last()]
    end = lambda order: raw.withColumn("__n", F.row_number().over(w.orderBy(*order))).where("__n = 1").select("finding_id", *_FIELDS)
    return field_changes(end(by), end(back), ["finding_id"], ["file", "vuln_class"])


@query(with_bases("""WITH s AS (SELECT cls, count(*) AS size FROM F WHERE cls IS NOT NULL GROUP BY cls), k AS (SELECT count(*) AS k, CAST(sum(size) AS BIGINT) AS total FROM s), q AS (SELECT cls, size, (size - 1) * 1.0 / greatest(total - k, 1) * (200 - k) AS share FROM s, k),
 b AS (SELECT *, CAST(floor(share) AS BIGINT) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, cls) AS place, 200 - count(*) OVER () - CAST(sum(floor(share)) OVER () AS BIGINT) AS give FROM q),
 a AS (SELECT cls, size, least(size, 1 + base + CASE WHEN place <= give THEN 1 ELSE 0 END) AS take FROM b)
 SELECT f.finding_id, f.cls, round(a.take * 1.0 / a.size, 9) AS probability FROM (SELECT finding_id, cls, row_number() OVER (PARTITION BY cls ORDER BY sha256('9|' || finding_uid), finding_id) AS n FROM F) f JOIN a USING (cls) WHERE n <= take""", "F"))
def set_stratified_draw(spark, folder):
    """200 findings drawn by a hash from the classes' places, with the probability each had."""
    rows = found(spark, folder).where("cls IS NOT NULL")
    places = statistics.allocate(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("size")), "size", 200, ["cls"])
    by = Window.partitionBy("cls").orderBy(F.sha2(F.concat(F.lit("9|"), "finding_uid"), 256), "finding_id")
    best = rows.select("finding_id", "cls", F.row_number().over(by).alias("n")).where("n <= 200")  # no class gets more
    return best.join(places, "cls").where("n <= take").select("finding_id", "cls", F.round(c("take") / c("size"), 9).alias("probability"))


@query("SELECT slug, CAST(count(*) AS BIGINT) AS passes, bool_and(coalesce(files_with_error = 0, false)) AS complete, CAST(sum(coalesce(files_with_error, 0)) AS BIGINT) AS errors, max(total_php_files) AS largest, array_to_string(list_sort(list_distinct(list(CASE WHEN zip_errors > 0 THEN 'zip' WHEN files_with_error > 0 THEN 'syntax' WHEN files_with_error IS NULL THEN 'unknown' END) FILTER (WHERE zip_errors > 0 OR files_with_error > 0 OR files_with_error IS NULL))), ',') AS reasons FROM parser_coverage WHERE slug IS NOT NULL GROUP BY slug")
def set_status_merge(spark, folder):
    """Several passes over a plugin as one: complete only if all are, sums of errors, the largest size, all reasons."""
    why = F.when(c("zip_errors") > 0, "zip").when(c("files_with_error") > 0, "syntax").when(c("files_with_error").isNull(), "unknown")
    rows = table(spark, folder, "parser_coverage").where("slug IS NOT NULL").groupBy("slug").agg(
        F.count(F.lit(1)).alias("passes"), F.bool_and(F.coalesce(c("files_with_error") == 0, F.lit(False))).alias("complete"), F.sum(F.coalesce("files_with_error", F.lit(0))).alias("errors"),
        F.max("total_php_files").alias("largest"), F.collect_set(why).alias("r"))
    return rows.select("slug", "passes", "complete", "errors", "largest", F.when(F.size("r") > 0, F.array_join(F.array_sort("r"), ",")).alias("reasons"))
