"""Reports over findings, patches and plugins as DataFrames; their SQL in ``reports`` is written apart, for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.keys import slug_key
from plumbline.operators import findings as base
from plumbline.operators.geometry import geometry
from plumbline.operators.rank import even_rank, mid_ranks
from plumbline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(f):
    QUERIES[f.__name__] = f
    return f


def rate(part: Column, whole: Column) -> Column:
    """A quotient rounded to nine places, null over nothing."""
    return F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), 9)


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def found(spark, folder) -> DataFrame:
    return base.findings(spark, folder)


def patched(spark, folder) -> DataFrame:
    return base.patches(spark, folder)


def placed(spark, folder) -> DataFrame:
    """Findings beside the patched files they lie in, with all rungs."""
    return geometry(found(spark, folder), patched(spark, folder))


def ordered(spark, folder) -> DataFrame:
    """Findings with their rank inside record and tool."""
    return base.ranked(found(spark, folder))


def ordered_hits(spark, folder) -> DataFrame:
    """Ranked findings beside the patched files they lie in."""
    return geometry(ordered(spark, folder), patched(spark, folder))


def per_record(rows: DataFrame, *tools: str) -> DataFrame:
    """One row for each record with 1 or 0 for each tool (a, b, c): whether any of its findings lies in a patched file."""
    return rows.groupBy("rkey").agg(*[F.max(flag((c("tool") == t) & c("in_file"))).alias(x) for t, x in zip(tools, "abc")])


# scans and labels


@query
def s04_php_files(spark, folder):
    rows = table(spark, folder, "source_files", "slug", "path")
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("files"), F.count_if(c("path").endswith(".php")).alias("exact_php"), F.count_if(F.lower("path").endswith(".php")).alias("any_php"))


@query
def s05_skipped(spark, folder):
    rows = table(spark, folder, "source_files", "slug", "path", "content").where(F.lower("path").endswith(".php"))
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("files"), F.count_if(c("content").isNull()).alias("unread"), F.count_if(~F.contains("content", F.lit("<?"))).alias("no_tag"))


@query
def s09_first_per_record(spark, folder):
    """The first patched file of each advisory, and whether there are others."""
    rows = patched(spark, folder).where("cve IS NOT NULL")
    return rows.groupBy("slug", "cve").agg(F.min_by("path", "gid").alias("path"), (F.count("path") > 1).alias("conflict"))


@query
def s16_coverage(spark, folder):
    rows = table(spark, folder, "parser_coverage")
    sums = {"zips": "zips", "zip_errors": "zip_errors", "files": "total_php_files", "skipped": "skipped_no_open_tag", "parsed": "parsed_files", "with_error": "files_with_error"}
    return rows.agg(*[F.sum(v).alias(k) for k, v in sums.items()], rate(F.sum("files_with_error"), F.sum("parsed_files")).alias("file_error_rate"), rate(F.sum("error_bytes"), F.sum("parsed_bytes")).alias("byte_error_rate"))


@query
def s17_cve_years(spark, folder):
    year = F.regexp_extract(F.coalesce("cve", F.lit("")), "^CVE-(.{4})-", 1)
    rows = found(spark, folder).select("rkey", F.when(year == "", "unknown").otherwise(year).alias("year"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("rkey").alias("records"))


@query
def s12_resolved(spark, folder):
    """The main file of each release: its index.php, else the first file by name."""
    files = table(spark, folder, "source_files", "record_id", "path").where("record_id IS NOT NULL")
    first = files.groupBy("record_id").agg(F.min(F.when(F.lower("path").endswith("/index.php"), c("path"))).alias("named"), F.min("path").alias("any"))
    rows = table(spark, folder, "plugins", "record_id", "slug").distinct().join(first, "record_id", "left")
    return rows.select("record_id", F.coalesce("named", "any").alias("path"), F.when(c("named").isNotNull(), "named").when(c("any").isNotNull(), "first").alias("how"))


# predicates


@query
def v01_vocabulary(spark, folder):
    return table(spark, folder, "class_aliases").groupBy("vuln_class").agg(F.count(F.lit(1)).alias("names"), F.min("alias").alias("first"))


@query
def v03_shadowed(spark, folder):
    """Sinks that the plugin defines itself, which hides the framework's function of that name."""
    rows = found(spark, folder)
    own = rows.select("slug", F.lower("fn").alias("name")).where("name IS NOT NULL").distinct()
    return rows.select("slug", "sink", F.lower("sink").alias("name")).join(own, ["slug", "name"], "left_semi").select("sink").distinct()


@query
def v05_environment(spark, folder):
    """Findings whose source is the request's environment."""
    source = c("source")
    return found(spark, folder).where((source == "getenv") | source.contains("HTTP_") | source.isin("$_SERVER", "REQUEST_URI", "QUERY_STRING")).select("finding_id")


@query
def v10_sql_receivers(spark, folder):
    low = F.lower("sink")
    receiver = low.contains("wpdb") | low.rlike("get_(results|row|var|col)$")
    return found(spark, folder).groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.bool_or(receiver).alias("receiver"))


#: Names of writers that are no sinks, and parts of names that tell a sink's kind.
BENIGN = ("update_option", "update_post_meta", "update_user_meta", "update_term_meta", "update_metadata", "update_site_option", "add_option", "delete_option", "delete_post_meta", "wp_update_post", "wp_insert_post", "wp_update_user")
MINED = (("source", "get_param|request_var|read_input"), ("rce", "exec|shell|passthru|popen"), ("upload", "put_contents|fwrite"), ("lfi", "get_contents|readfile"))


@query
def v14_mined_names(spark, folder):
    """What a sink's name alone tells, in the order of the table."""
    verdict = F.lit("benign")
    for kind, parts in reversed(MINED):
        verdict = F.when(c("name").rlike(parts), kind).otherwise(verdict)
    rows = found(spark, folder).where("sink IS NOT NULL").groupBy(F.lower("sink").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("name", "n", F.when(c("name").isin(*BENIGN), "benign").otherwise(verdict).alias("verdict"))


@query
def v13_slices(spark, folder):
    """How a message reads: with a sanitizer's name, from a superglobal, or neither."""
    reach = F.when(c("message").rlike("esc_|sanitize_"), "guarded").when(c("source").startswith("$_"), "likely").otherwise("unclear")
    return found(spark, folder).select("finding_id", reach.alias("reachability"))


@query
def v15_vendor_paths(spark, folder):
    """Paths of build, vendor and asset files, which no finding in matters."""
    where = c("path").rlike(r"(^|/)(vendor|node_modules|assets|dist|build|languages|tests?|\.github)/|\.(min\.js|min\.css|css|scss|map|po|mo|pot|md|txt|json|lock|svg|png|jpe?g|gif)$")
    return found(spark, folder).where(where).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# scalar classifiers


@query
def f33_breadth(spark, folder):
    rows = found(spark, folder).where("cls IS NOT NULL").groupBy("rkey").agg(F.count_distinct("cls").alias("n_cls"))
    return rows.withColumn("band", F.when(c("n_cls") == 1, "1").when(c("n_cls") <= 3, "2-3").otherwise("4+"))


@query
def f33_terciles(spark, folder):
    """Records by size: cuts are the sizes at floor(m/3) and floor(2m/3) in their order, found in the table of distinct sizes."""
    sizes = found(spark, folder).groupBy("rkey").agg(F.count(F.lit(1)).alias("n"))
    steps = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = steps.select("n", F.sum("k").over(Window.orderBy("n")).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("m"))
    at = lambda part: F.min(F.when(c("upto") >= F.floor(c("m") * part / 3) + 1, c("n")))
    cuts = upto.agg(at(1).alias("low"), at(2).alias("high"))
    rows = sizes.crossJoin(F.broadcast(cuts))  # one row
    return rows.select("rkey", "n", F.when(c("n") <= c("low"), "small").when(c("n") <= c("high"), "medium").otherwise("large").alias("tercile"))


def mechanism() -> Column:
    return F.when(c("cls").isin("auth", "csrf"), "missing-guard").when(F.contains(F.lower("source"), F.lit("unserialize(untrusted)")), "risk-pattern").otherwise("proven-taint")


@query
def f34_mechanism(spark, folder):
    return found(spark, folder).where("cls IS NOT NULL").groupBy(mechanism().alias("mechanism")).agg(F.count(F.lit(1)).alias("n"))


@query
def f35_signatures(spark, folder):
    sign = F.when(F.contains(F.lower("source"), F.lit("unserialize(untrusted)")), "risk:unserialize").otherwise(F.concat("cls", F.lit(":"), F.regexp_replace("sink", "^[$>-]+", "")))
    return found(spark, folder).where("cls IS NOT NULL AND sink IS NOT NULL").groupBy(sign.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def tier(concrete: Column) -> Column:
    """3 for concrete sinks, 1 for findings by rule of thumb, 2 for the others."""
    return F.when(c("cls").isin("csrf", "auth") | (F.coalesce("conf", F.lit(0.6)) <= 0.45), 1).when(concrete, 3).otherwise(2)


@query
def f36_tiers(spark, folder):
    sink = F.lower("sink")
    concrete = sink.contains("wpdb") | sink.isin("echo", "print", "printf", "eval", "move_uploaded_file", "unlink")
    return found(spark, folder).groupBy(tier(concrete).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# joins


@query
def j11_in_patch(spark, folder):
    return placed(spark, folder).groupBy("finding_id").agg(F.bool_or("in_file").alias("in_file"))


@query
def j12_outside(spark, folder):
    return found(spark, folder).select("finding_id").join(placed(spark, folder).where("in_file").select("finding_id"), "finding_id", "left_anti")


@query
def j13_window(spark, folder):
    lines = base.changed_lines(patched(spark, folder)).withColumnRenamed("line", "at")
    near = placed(spark, folder).select("finding_id", "gid", "line").join(lines, "gid").where(F.abs(c("line") - c("at")) <= 5)
    return near.groupBy("finding_id", "gid").agg(F.count(F.lit(1)).alias("near"))


@query
def j14_innermost(spark, folder):
    inside = placed(spark, folder).select("finding_id", "gid", "line").join(base.callables(patched(spark, folder)), "gid").where("line BETWEEN s AND e")
    best = inside.groupBy("finding_id", "gid").agg(F.min(F.struct((c("e") - c("s")).alias("w"), "s", "e")).alias("x"))
    return best.select("finding_id", "gid", "x.s", "x.e")


@query
def j16_hunks(spark, folder):
    inside = placed(spark, folder).select("finding_id", "gid", "line").join(base.hunks(patched(spark, folder)), "gid").where("line BETWEEN h_start AND h_end")
    return inside.select("finding_id", "gid", "h_start", "h_end", "h_kind")


@query
def j17_deficits(spark, folder):
    """Guard deficits of findings on missing guards: the greatest known at their place, 1 where none is."""
    rows = found(spark, folder)
    key = ["slug", "path", "line", "cls"]
    known = rows.where("deficit >= 0").groupBy(*key).agg(F.max("deficit").alias("d"))
    asked = c("cls").isin("csrf", "auth") & (c("source") == "request")
    return rows.select("finding_id", "source", *key).join(known, key, "left").select("finding_id", F.when(asked, F.coalesce("d", F.lit(1.0))).otherwise(-1.0).alias("deficit"))


@query
def j18_file_entry(spark, folder):
    return found(spark, folder).groupBy("slug", "path").agg(F.min(base.keyed(base.ENTRY_PRIORITY, "ep", 9)).alias("priority"))


def keys_of(rows: DataFrame, tool: str) -> DataFrame:
    return rows.where(c("tool") == tool).select("rkey").distinct()


@query
def j20_common_records(spark, folder):
    rows = found(spark, folder)
    return keys_of(rows, "wpt").join(keys_of(rows, "progpilot"), "rkey", "left_semi")


@query
def j21_full_denominator(spark, folder):
    """Every record for every tool: a tool that says nothing has no hit. The tools are one row, the records are not multiplied by a table."""
    rows = placed(spark, folder)
    hit = rows.groupBy("rkey", "tool").agg(F.max(flag(c("in_file"))).alias("hit"))
    said = hit.groupBy("rkey").agg(F.collect_set(F.when(c("hit") == 1, c("tool"))).alias("by"))
    tools = F.broadcast(rows.agg(F.array_sort(F.collect_set("tool")).alias("tools")))
    return said.crossJoin(tools).select("rkey", "by", F.explode("tools").alias("tool")).select("rkey", "tool", flag(F.array_contains("by", c("tool"))).alias("hit"))


@query
def j22_all_tools(spark, folder):
    rows = found(spark, folder)
    n = F.broadcast(rows.agg(F.count_distinct("tool").alias("all")))  # one row
    return rows.groupBy("rkey").agg(F.count_distinct("tool").alias("n")).join(n, c("n") == c("all")).select("rkey")


@query
def j23_manifest(spark, folder):
    told = table(spark, folder, "parser_coverage", "record_id", "total_php_files").where("record_id IS NOT NULL").groupBy("record_id").agg(F.max("total_php_files").alias("total_php_files"), F.lit(True).alias("listed"))
    rows = table(spark, folder, "plugins", "record_id", "slug").distinct().join(told, "record_id", "left")
    return rows.select("record_id", "slug", "total_php_files", F.coalesce("listed", F.lit(False)).alias("listed"))


@query
def j23_extra(spark, folder):
    """Files whose release is not among those that the coverage pass covers."""
    rows = table(spark, folder, "plugins", "record_id").distinct()
    return rows.join(table(spark, folder, "parser_coverage", "record_id"), "record_id", "left_anti")


@query
def j24_before_after(spark, folder):
    rows = found(spark, folder).where(c("tool").isin("wpt", "progpilot")).groupBy("rkey").agg(F.count_if(c("tool") == "wpt").alias("x"), F.count_if(c("tool") == "progpilot").alias("y"))
    rows = rows.select("rkey", F.nullif("x", F.lit(0)).alias("before"), F.nullif("y", F.lit(0)).alias("after"))
    change = F.when(c("before").isNull(), "gained").when(c("after").isNull(), "lost").when(c("after") > c("before"), "more").when(c("after") < c("before"), "fewer").otherwise("same")
    return rows.withColumn("change", change)


@query
def j25_multiset(spark, folder):
    """What either tool has more often than the other, by place, class and sink, in both directions."""
    key = ["path", "line", "cls", "sink"]
    n = found(spark, folder).where(c("tool").isin("wpt", "progpilot")).groupBy(*key).agg(F.count_if(c("tool") == "wpt").alias("a"), F.count_if(c("tool") == "progpilot").alias("b"))
    return n.where("a <> b").select(*key, F.when(c("a") > c("b"), "wpt").otherwise("progpilot").alias("more"), F.abs(c("a") - c("b")).alias("times"))


# aggregations


@query
def a01_keep_best(spark, folder):
    key = ["slug", "path", "line", "cls", "sink"]
    best = found(spark, folder).groupBy(*key).agg(F.min_by(F.struct("finding_id", "conf"), F.struct(-F.coalesce("conf", F.lit(-1.0)), "finding_id")).alias("x"))
    return best.select(*key, "x.finding_id", "x.conf")


@query
def a02_cap_one(spark, folder):
    rows = found(spark, folder).where("cls = 'deserial'")
    return rows.groupBy("slug", "path").agg(F.min(F.struct("rank", "finding_id")).alias("x")).select("slug", "path", "x.finding_id")


@query
def a03_classes(spark, folder):
    return found(spark, folder).groupBy(F.coalesce("cls", F.lit("none")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def _class_hits(spark, folder):
    return placed(spark, folder).where("cls IS NOT NULL").groupBy("rkey", "cls").agg(F.bool_or("in_file").alias("hit"))


@query
def a04_emission(spark, folder):
    rows = _class_hits(spark, folder).rollup("cls").agg(F.count(F.lit(1)).alias("records"), F.count_if("hit").alias("hits"))
    return rows.withColumn("cls", F.coalesce("cls", F.lit("ALL")))


@query
def a05_shard_merge(spark, folder):
    """Counts of the shards are summed up before the rate is formed."""
    shards = placed(spark, folder).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_file").alias("hits"))
    return shards.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), rate(F.sum("hits"), F.sum("n")).alias("rate"))


@query
def a06_precision(spark, folder):
    """Precision of files, lines and functions, and the part of all patched files that a tool finds."""
    rows = placed(spark, folder).groupBy("tool").agg(
        rate(F.count_if("in_file"), F.count(F.lit(1))).alias("file_precision"), rate(F.count_if(c("distance") <= 5), F.count(F.lit(1))).alias("line_precision"),
        rate(F.count_if("same_callable"), F.count(F.lit(1))).alias("function_precision"), F.count_distinct(F.when(c("in_file"), c("gid"))).alias("files_found"))
    files = F.broadcast(patched(spark, folder).where("coalesce(is_php, true)").agg(F.count(F.lit(1)).alias("all")))  # one row
    return rows.crossJoin(files).withColumn("file_recall", rate(c("files_found"), c("all"))).drop("all")


@query
def a07_class_sets(spark, folder):
    rows = found(spark, folder).where("cls IS NOT NULL").groupBy("slug", "cls").agg(F.bool_or(c("tool") == "wpt").alias("a"), F.bool_or(c("tool") != "wpt").alias("b"))
    n = rows.agg(F.count_if(c("a") & c("b")).alias("tp"), F.count_if(c("a") & ~c("b")).alias("fp"), F.count_if(~c("a") & c("b")).alias("missed"))
    return n.withColumns({"precision_proxy": rate(c("tp"), c("tp") + c("fp")), "recall": rate(c("tp"), c("tp") + c("missed"))})


@query
def a08_micro_macro(spark, folder):
    records = placed(spark, folder).groupBy("slug", "rkey").agg(F.max(flag(c("in_file"))).alias("h"))
    slugs = records.groupBy("slug").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    return slugs.agg(rate(F.sum("h"), F.sum("n")).alias("micro"), F.round(F.avg(c("h") / c("n")), 9).alias("macro"))


@query
def a09_class_macro(spark, folder):
    rates = placed(spark, folder).groupBy("cls").agg(F.avg(flag(c("in_file"))).alias("r"))
    names = table(spark, folder, "class_aliases").select(c("vuln_class").alias("cls")).distinct().join(rates, "cls", "left")
    return names.agg(F.round(F.avg(F.coalesce("r", F.lit(0.0))), 9).alias("absent_as_zero"), F.round(F.avg("r"), 9).alias("absent_skipped"))


def _pairs(spark, folder):
    """Counts of classes by place and tool: what two tools say of a place is multiplied, never listed pair by pair."""
    rows = found(spark, folder).where("cls IS NOT NULL AND slug IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL")
    n = rows.groupBy("slug", "path", "line", "tool", "cls").agg(F.count(F.lit(1)).alias("n"))
    side = lambda tool, x: n.where(c("tool") == tool).select("slug", "path", "line", c("cls").alias(x), c("n").alias(f"n_{x}"))
    return side("wpt", "a").join(side("progpilot", "b"), ["slug", "path", "line"])


@query
def a10_confusion(spark, folder):
    return _pairs(spark, folder).groupBy("a", "b").agg(F.sum(c("n_a") * c("n_b")).alias("n"))


@query
def a11_rates(spark, folder):
    hit, inter = c("in_file"), c("inter")
    rows = placed(spark, folder).where("inter IS NOT NULL AND ep IS NOT NULL").rollup("ep").agg(
        F.count_if(hit & inter).alias("tp"), F.count_if(~hit & ~inter).alias("tn"), F.count_if(hit & ~inter).alias("missed"), F.count_if(~hit & inter).alias("fp"))
    rows = rows.withColumns({"ep": F.coalesce("ep", F.lit("ALL")), "tpr": rate(c("tp"), c("tp") + c("missed")), "tnr": rate(c("tn"), c("tn") + c("fp"))})
    return rows


@query
def a12_histogram(spark, folder):
    return found(spark, folder).groupBy("slug").agg(F.count_distinct("rkey").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("plugins"))


@query
def a13_failures(spark, folder):
    cause = F.when(c("zip_errors") > 0, "archive").when(c("files_with_error") > 0, "syntax").when(c("skipped_no_open_tag") > 0, "no tag").otherwise("none")
    return table(spark, folder, "parser_coverage").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("releases"), F.sum("total_php_files").alias("files"))


@query
def a14_accounting(spark, folder):
    """Outcomes of the coverage pass must add up: files skipped, parsed and in broken archives are no more than all, release by release."""
    rows = table(spark, folder, "parser_coverage")
    known = c("total_php_files").isNotNull() & c("parsed_files").isNotNull() & c("skipped_no_open_tag").isNotNull()
    rest = c("total_php_files") - c("parsed_files") - c("skipped_no_open_tag")
    return rows.agg(F.count(F.lit(1)).alias("releases"), F.count_if(~known).alias("unknown"), F.count_if(known & (rest == 0)).alias("closed"), F.count_if(known & (rest > 0)).alias("files_missing"), F.count_if(known & (rest < 0)).alias("files_too_many"))


@query
def a15_census(spark, folder):
    bad = c("files_with_error")
    n = table(spark, folder, "parser_coverage").agg(F.count(F.lit(1)).alias("releases"), F.count_if(bad == 0).alias("clean"), F.count_if(bad.isNull()).alias("unknown"))
    return n.withColumn("rate_of_known", rate(c("clean"), c("releases") - c("unknown")))


@query
def a16_transitions(spark, folder):
    """From each wave a sampled finding is in to the next later one it is in again."""
    waves = table(spark, folder, "study_sample", "finding_uid", "wave_id").distinct()
    later = F.lead("wave_id").over(Window.partitionBy("finding_uid").orderBy(c("wave_id").asc_nulls_first()))
    steps = waves.where("finding_uid IS NOT NULL").select("finding_uid", F.coalesce("wave_id", F.lit(0)).alias("before"), F.when(c("wave_id").isNotNull(), later).alias("after"))
    lone = waves.where("finding_uid IS NULL").select("finding_uid", F.coalesce("wave_id", F.lit(0)).alias("before"), F.lit(None).cast("long").alias("after"))
    return steps.unionByName(lone).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query
def a17_patch_shapes(spark, folder):
    n = F.size(F.array_distinct(F.filter(F.coalesce("changed_vuln_lines", F.array().cast("array<int>")), lambda x: F.lit(True))))
    shape = F.when(c("status") != "modified", c("status")).when(n == 0, "insert-only").when(n <= 5, "small").otherwise("large")
    return patched(spark, folder).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("files"))


@query
def a18_medians(spark, folder):
    return found(spark, folder).groupBy("tool").agg(F.median("line").alias("line"), F.median("conf").alias("conf"))


@query
def a19_reliability(spark, folder):
    """Smoothed share of findings in patched files by class and sink; classes with a sink not seen have 0.1."""
    rows = placed(spark, folder).where("cls IS NOT NULL").groupBy("cls", "sink").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_file").alias("hits"))
    unseen = table(spark, folder, "class_aliases").select(c("vuln_class").alias("cls")).distinct().select("cls", F.lit("(unseen)").alias("sink"), F.lit(0.1).alias("reliability"))
    return rows.select("cls", "sink", F.round((c("hits") + 0.5) / (c("n") + 5.0), 9).alias("reliability")).unionByName(unseen)


@query
def a20_burials(spark, folder):
    """How often findings of a class and sink stand above the first one in a patched file."""
    rows = ordered_hits(spark, folder)
    once = rows.groupBy("rkey", "tool", "finding_id").agg(F.min("rk").alias("rk"), F.bool_or("in_file").alias("hit"), F.min(F.struct("cls", "sink")).alias("x"))
    first = once.where("hit").groupBy("rkey", "tool").agg(F.min("rk").alias("first"))
    return once.join(first, ["rkey", "tool"]).where("rk < first").groupBy("x.cls", "x.sink").agg(F.count(F.lit(1)).alias("times"))


@query
def a21_name_collisions(spark, folder):
    """Functions that stand in several files of a plugin, and the part of cross-function findings in them."""
    rows = found(spark, folder).where("fn IS NOT NULL").groupBy("slug", "fn").agg(F.count_distinct("path").alias("files"), F.count_if("inter").alias("across"))
    n = rows.agg(F.count(F.lit(1)).alias("names"), F.count_if(c("files") > 1).alias("ambiguous"), F.sum("across").alias("across"), F.sum(F.when(c("files") > 1, c("across")).otherwise(0)).alias("across_ambiguous"))
    return n


@query
def a22_throughput(spark, folder):
    """Success as completion times accuracy, and what success would be with the best completion of all tools."""
    lists = placed(spark, folder).groupBy("rkey", "tool").agg(F.bool_or(c("conf").isNotNull()).alias("done"), F.bool_or("in_file").alias("hit"))
    n = lists.groupBy("tool").agg(F.count(F.lit(1)).alias("lists"), F.count_if("done").alias("d"), F.count_if(c("done") & c("hit")).alias("h"))
    best = F.broadcast(n.agg(F.max(c("d") / c("lists")).alias("best")))  # one row
    return n.crossJoin(best).select("tool", "lists", rate(c("d"), c("lists")).alias("completed"), rate(c("h"), c("d")).alias("accuracy"), F.round(c("best") * c("h") / F.nullif("d", F.lit(0)), 9).alias("counterfactual"))


@query
def a23_budget_curve(spark, folder):
    """Records hit within a budget of findings shown: a record counts as lost if its first hit lies beyond."""
    rows = ordered_hits(spark, folder).groupBy("rkey", "tool").agg(F.min(F.when(c("in_file"), c("rk"))).alias("first"))
    budgets = F.explode(F.array(*[F.lit(b) for b in (1, 3, 10, 30, 100)]))
    n = rows.withColumn("budget", budgets).groupBy("tool", "budget").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("first") <= c("budget")).alias("hits"))
    return n.withColumn("rate", rate(c("hits"), c("n")))


@query
def a24_cohorts(spark, folder):
    year = F.coalesce(F.substring("cve", 5, 4), F.lit("unknown"))
    return placed(spark, folder).groupBy(year.alias("year")).agg(F.count_distinct("rkey").alias("records"), F.round(F.avg(flag(c("in_file"))), 9).alias("rate"))


@query
def a25_auth_split(spark, folder):
    part = F.when(c("deficit") >= 1, "unguarded").when(c("deficit") >= 0, "partly").otherwise("not applicable")
    rows = found(spark, folder).where("cls = 'auth'").select(part.alias("part")).rollup("part").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("part", F.coalesce("part", F.lit("ALL")))


@query
def a26_best_of_file(spark, folder):
    return found(spark, folder).groupBy("slug", "path").agg(F.max(base.keyed(base.ENTRY_WEIGHT, "ep", 0.5)).alias("weight"))


@query
def a27_dependence(spark, folder):
    """Whether a place and class determine the source: keys with a single one, their mean number, and the most frequent message."""
    rows = found(spark, folder).where("cls IS NOT NULL")
    keys = rows.groupBy("slug", "path", "line", "cls").agg(F.count_distinct("source").alias("sources"))
    mode = rows.where("message IS NOT NULL").groupBy("message").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct(-c("n"), "message")).alias("x")).select("x.message")
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.count_if(c("sources") == 1).alias("single"), F.round(F.avg("sources"), 9).alias("mean")).crossJoin(F.broadcast(mode))


@query
def a29_ceiling(spark, folder):
    """What a perfect ranking could reach: records with a finding of the class in a patched file, at any rank, and what the first rank reaches."""
    rows = ordered_hits(spark, folder).where("cls IS NOT NULL").groupBy("rkey", "cls").agg(F.bool_or("in_file").alias("hit"), F.bool_or(c("in_file") & (c("rk") == 1)).alias("first"))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("records"), F.count_if("hit").alias("reachable"), F.count_if(c("hit") & ~c("first")).alias("recoverable"))


@query
def a30_predicates(spark, folder):
    d = F.coalesce("distance", F.lit(99))
    return placed(spark, folder).agg(F.count_if(c("in_hunk") & (d > 0)).alias("hunk_not_exact"), F.count_if((d == 0) & ~c("in_hunk")).alias("exact_not_hunk"), F.count_if(c("in_hunk") & ~c("in_file")).alias("hunk_not_file"))


# rankings

KS = (1, 3, 5, 10)


@query
def k02_enumerated(spark, folder):
    n = F.row_number().over(Window.partitionBy("run_uid", "tool").orderBy(c("rank").asc_nulls_first(), "finding_id"))
    return found(spark, folder).select("finding_id", n.alias("n"))


@query
def k03_top_k(spark, folder):
    """Success at k: the first hit's rank is formed once for each record and tool, then compared with every k."""
    rows = ordered_hits(spark, folder).groupBy("tool", "rkey").agg(F.min(F.when(c("in_file"), c("rk"))).alias("first"))
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, KS))))
    return rows.groupBy("tool", "k").agg(F.count(F.lit(1)).alias("records"), F.count_if(c("first") <= c("k")).alias("hits"))


@query
def k04_precision_at_k(spark, folder):
    rows = ordered_hits(spark, folder).where("rk <= 5").groupBy("tool", "rkey", "finding_id").agg(F.max(flag(c("in_file"))).alias("tp"))
    n = rows.groupBy("tool").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("shown"))
    return n.withColumn("precision_5", rate(c("tp"), c("shown")))


@query
def k05_first_hits(spark, folder):
    """The first rank at which each rung is reached."""
    rungs = {"file": c("in_file"), "near": c("distance") <= 5, "within2": c("within2"), "within10": c("within10"), "exact": c("distance") == 0, "hunk": c("in_hunk"), "callable": c("same_callable"), "boundary": c("near_boundary"), "top": c("at_top")}
    return ordered_hits(spark, folder).groupBy("rkey", "tool").agg(*[F.min(F.when(v, c("rk"))).alias(f"first_{k}") for k, v in rungs.items()])


@query
def k06_miss_buckets(spark, folder):
    rows = ordered_hits(spark, folder).groupBy("rkey", "tool").agg(F.min(F.when(c("in_file"), c("rk"))).alias("first"), F.count("cls").alias("classes"))
    bucket = F.when(c("classes") == 0, "no_class").when(c("first").isNull(), "wrong_file").when(c("first") > 1, "ranked_below_1").otherwise("at_1")
    return rows.groupBy("tool", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("records"))


@query
def k07_severity(spark, folder):
    level = F.when(c("conf") >= 0.7, 3).when(c("conf") >= 0.5, 2).otherwise(1)
    n = F.row_number().over(Window.partitionBy("rkey", "tool").orderBy(level.desc(), c("rank").asc_nulls_first(), "finding_id"))
    return found(spark, folder).select("finding_id", n.alias("n"))


def _weighted(rows: DataFrame, weights, score) -> DataFrame:
    """``rows`` once for each weight ``w``, with the rank ``n`` that the weight gives inside record and tool."""
    many = rows.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    by = Window.partitionBy("w", "rkey", "tool").orderBy(F.round(score, 6).desc(), c("rank").asc_nulls_first(), "finding_id")
    return many.withColumn("n", F.row_number().over(by))


@query
def k09_variants(spark, folder):
    """How many lists begin differently under other weights of the flow's confidence."""
    rows = _weighted(ordered(spark, folder), (0.0, 2.0, 4.0), c("score") + (c("w") - 1.0) * F.coalesce("conf", F.lit(0.6)))
    lists = rows.where("n = 1").select(c("w").alias("flow"), (c("rk") != 1).alias("changed"))
    return lists.groupBy("flow").agg(F.count(F.lit(1)).alias("lists"), F.count_if("changed").alias("changed"))


@query
def k10_best_weight(spark, folder):
    """The weight with most first hits among those that lose no class by macro rate; ties go to the later one."""
    hit = placed(spark, folder).groupBy("finding_id").agg(F.bool_or("in_file").alias("hit"))
    rows = _weighted(ordered(spark, folder).join(hit, "finding_id"), (0, 1, 2, 4), c("score") + (c("w") - 1) * F.coalesce("conf", F.lit(0.6)))
    firsts = rows.where("n = 1").groupBy("w", "tool").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lists"))
    total = firsts.groupBy("w").agg(F.sum("hits").alias("hits"), F.round(F.avg(c("hits") / c("lists")), 9).alias("macro"))
    plain = F.broadcast(total.where("w = 1").select(c("macro").alias("m1")))  # one row
    best = total.crossJoin(plain).where("macro >= m1").agg(F.max_by(F.struct("w", "hits"), F.struct("hits", "w")).alias("x"))
    return best.select(c("x.w").alias("flow"), "x.hits")


@query
def k11_tier_sweep(spark, folder):
    rows = ordered(spark, folder).withColumn("tier", tier(F.contains(F.lower("sink"), F.lit("wpdb"))))
    first = _weighted(rows, (0, 1, 2), c("score") + c("w") * c("tier")).where("n = 1")
    return first.groupBy("w").agg(F.count_if(c("tier") == 3).alias("strong_first"))


def drawn_hits(rows: DataFrame, counts: DataFrame, seeds: int = 100, best: int = 3, most: int = 1 << 15) -> DataFrame:
    """(seed, hits): records with a hit among the first ``best`` of any of their lists, a list being in the order of md5 by seed.

    ``rows`` has finding_id, finding_uid, rkey, tool and hit; ``counts`` the lists' sizes ``n`` by rkey and tool, no less
    than in ``rows``. A list is gathered once for all seeds, one of more than ``most`` rows in several parts, whose best
    are put together. Nothing is drawn where the lists' numbers decide. A record's seeds are the bits of longs.
    """
    long = counts.where(c("n") > most).select(c("rkey").alias("__rkey"), c("tool").alias("__tool"), F.ceil(c("n") / most).alias("parts"))
    # at most one row for each ``most`` findings
    dealt = rows.join(F.broadcast(long), (c("rkey") == c("__rkey")) & c("tool").eqNullSafe(c("__tool")), "left")
    dealt = dealt.withColumn("part", F.when(c("parts").isNotNull(), F.pmod(F.xxhash64("finding_id"), c("parts"))).otherwise(-1))
    item = F.when(c("rkey").isNotNull(), F.struct("finding_uid", "finding_id", "hit"))
    lists = dealt.groupBy("rkey", "tool", "part").agg(F.collect_list(item).alias("items"), F.count_if("hit").alias("in"), F.count_if(~c("hit")).alias("out"))
    whole, sure = c("part") < 0, c("out") < best
    asked = lists.withColumn("items", F.when(~whole | (c("in") > 0) & ~sure, c("items")).otherwise(F.array().cast(lists.schema["items"].dataType)))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.lit(f"{i}|").alias("head")) for i in range(1, seeds + 1)]))
    many = asked.withColumn("__s", each).select("*", "__s.seed", "__s.head")

    def draw(x: Column) -> Column:
        md5 = F.md5(F.concat(c("head"), x["finding_uid"]))
        return F.struct(md5.isNull().alias("none"), md5.alias("md5"), x["finding_id"].alias("id"), x["hit"].alias("hit"))

    first = lambda items: F.slice(F.sort_array(items), 1, best)
    shown = lambda items: F.exists(items, lambda x: x["hit"])
    drawn = first(F.transform("items", draw))
    done = many.where(whole).select("rkey", "seed", ((c("in") > 0) & (sure | shown(drawn))).alias("shown"))
    parts = many.where(~whole).select("rkey", "tool", "seed", drawn.alias("top")).groupBy("rkey", "tool", "seed").agg(F.flatten(F.collect_list("top")).alias("top"))
    done = done.unionByName(parts.select("rkey", "seed", shown(first(c("top"))).alias("shown")))
    words = range((seeds + 62) // 63)
    bit = lambda w: F.when(c("shown") & (F.floor((c("seed") - 1) / 63) == w), F.call_function("shiftleft", F.lit(1).cast("long"), (c("seed") - 1) % 63)).otherwise(F.lit(0).cast("long"))
    records = done.groupBy("rkey").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
    totals = records.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright(f"w{(i - 1) // 63}", (i - 1) % 63).bitwiseAND(F.lit(1).cast("long"))).alias(f"s{i}") for i in range(1, seeds + 1)])
    return totals.where("n > 0").select(F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), c(f"s{i}").alias("hits")) for i in range(1, seeds + 1)])).alias("x")).select("x.seed", "x.hits")


@query
def k12_random_order(spark, folder):
    """Hits among the first three of lists in a hash's order, for 100 seeds."""
    places = patched(spark, folder).where("coalesce(is_php, true)").select(c("slug").alias("__g"), c("cve").alias("__cve"), c("path").alias("__path")).distinct()
    rows = found(spark, folder).where("finding_id IS NOT NULL").select("finding_id", "finding_uid", "rkey", "tool", slug_key("slug").alias("__slug"), "cve", "path")
    rows = rows.join(places, (c("__slug") == c("__g")) & c("cve").eqNullSafe(c("__cve")) & (c("path") == c("__path")), "left")
    key = F.concat("slug", F.lit("|"), F.coalesce("cve", F.lit("-"))).alias("rkey")
    counts = table(spark, folder, "findings", "slug", "cve", "tool").groupBy(key, "tool").agg(F.count(F.lit(1)).alias("n"))
    return drawn_hits(rows.select("finding_id", "finding_uid", "rkey", "tool", c("__g").isNotNull().alias("hit")), counts)


@query
def k13_top_sinks(spark, folder):
    n = found(spark, folder).where("cls IS NOT NULL AND sink IS NOT NULL").groupBy("cls", "sink").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "sink"))
    return n.withColumn("i", place).where("i <= 3").drop("i")


@query
def k14_occurrence(spark, folder):
    n = F.row_number().over(Window.partitionBy("rkey", "tool", "path", "line", "cls").orderBy("finding_id")) - 1
    return found(spark, folder).select("finding_id", n.alias("occurrence"))


@query
def k17_runs(spark, folder):
    """Maximal runs of one class in the order of identifiers: stretches of the order are counted apart, and meet at their borders."""
    rows = even_rank(found(spark, folder).where("cls IS NOT NULL").select("tool", "cls", "finding_id"), ["tool"], [c("finding_id")], "place")
    before = rows.select("tool", (c("place") + 1).alias("place"), c("cls").alias("before"))
    both = rows.join(before, ["tool", "place"], "left")
    return both.groupBy("tool").agg(F.count_if(c("before").isNull() | (c("before") != c("cls"))).alias("runs"), F.count(F.lit(1)).alias("n"))


# sets


@query
def set_union(spark, folder):
    return found(spark, folder).where(c("tool").isin("wpt", "progpilot") & c("sink").isNotNull()).select(c("sink").alias("name")).distinct()


@query
def set_intersection(spark, folder):
    rows = found(spark, folder)
    return keys_of(rows, "wpt").intersect(keys_of(rows, "semgrep"))


@query
def set_difference(spark, folder):
    """Records of all other tools that the second has nothing for."""
    rows = found(spark, folder)
    return rows.where("tool <> 'progpilot'").select("rkey").subtract(keys_of(rows, "progpilot"))


@query
def set_round_robin(spark, folder):
    """200 findings dealt in turn from the cells of class and tool: only a cell's first 200 can be among them."""
    by = Window.partitionBy("cls", "tool").orderBy(F.md5(F.concat(F.lit("7|"), "finding_uid")))
    rows = found(spark, folder).where("cls IS NOT NULL").withColumn("i", F.row_number().over(by)).where("i <= 200")
    return rows.orderBy("i", "cls", "tool").limit(200).select("finding_id")


# patches


@query
def x03_statuses(spark, folder):
    return patched(spark, folder).groupBy("slug", "cve").agg(*[F.count_if(c("status") == s).alias(s) for s in ("modified", "deleted", "added")])


@query
def x04_unanchorable(spark, folder):
    empty = F.coalesce(F.size("changed_vuln_lines"), F.lit(0)) <= 0
    return patched(spark, folder).agg(F.count(F.lit(1)).alias("files"), F.count_if(c("status") == "deleted").alias("deleted"), F.count_if((c("status") == "modified") & empty).alias("insert_only"))


@query
def x05_geometry(spark, folder):
    return placed(spark, folder).select("finding_id", "gid", "in_file", "distance", "within2", "within5", "within10", "in_hunk", "near_boundary")


@query
def x07_class_score(spark, folder):
    rows = ordered_hits(spark, folder).where("cls IS NOT NULL").groupBy("tool", "cls", "rkey").agg(F.bool_or(c("in_file") & (c("rk") <= 10)).alias("a"), F.bool_or((c("distance") <= 5) & (c("rk") <= 10)).alias("b"))
    return rows.groupBy("tool", "cls").agg(F.count(F.lit(1)).alias("records"), F.count_if("a").alias("file_10"), F.count_if("b").alias("near_10"))


@query
def x09_withheld(spark, folder):
    """No credit at any rung where the release was not read to its end; what describes the patch stays."""
    bad = table(spark, folder, "parser_coverage").where("files_with_error > 0 AND slug IS NOT NULL").select("slug", F.lit(True).alias("bad")).distinct()
    rows = placed(spark, folder).join(bad, "slug", "left").withColumn("withheld", F.coalesce("bad", F.lit(False)))
    return rows.select("finding_id", "gid", "withheld", *[(c(x) & ~c("withheld")).alias(x) for x in ("in_file", "within5", "in_hunk")], "near_boundary")


# statistics without resampling


@query
def t06_weighted_rate(spark, folder):
    cells = placed(spark, folder).where("cls IS NOT NULL").groupBy("cls", "tool").agg(F.count(F.lit(1)).alias("m"), F.avg(flag(c("in_file"))).alias("p"))
    return cells.agg(F.round(F.sum(c("m") * c("p")) / F.sum("m"), 9).alias("rate"))


@query
def t08_inverse_weights(spark, folder):
    """Every plugin weighs the same: hits and rows are summed for each plugin, then weighed."""
    slugs = placed(spark, folder).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_file").alias("h"))
    return slugs.agg(F.round(F.sum(c("h") / c("n")) / F.count(F.lit(1)), 9).alias("rate"))


def _raters(spark, folder):
    return per_record(placed(spark, folder), "wpt", "progpilot")


@query
def t13_kappa(spark, folder):
    """Cohen's kappa of two tools over records; 1 where chance alone gives full agreement."""
    n = _raters(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(c("a") == c("b"))).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = c("pa") * c("pb") + (1 - c("pa")) * (1 - c("pb"))
    return n.withColumn("pe", pe).select(F.when(c("pe") >= 1, 1.0).otherwise(F.round((c("po") - c("pe")) / (1 - c("pe")), 9)).alias("kappa"), "n")


@query
def t14_pabak(spark, folder):
    return _raters(spark, folder).agg(F.round(2 * F.avg(flag(c("a") == c("b"))) - 1, 9).alias("pabak"))


@query
def t15_fleiss(spark, folder):
    """Fleiss' kappa of all tools as raters of records, as many as there are."""
    rows = placed(spark, folder)
    k = F.broadcast(rows.agg(F.count_distinct("tool").cast("double").alias("k")))  # one row
    h = rows.groupBy("rkey").agg(F.count_distinct(F.when(c("in_file"), c("tool"))).cast("double").alias("h")).crossJoin(k)
    miss = c("k") - c("h")
    x = h.agg(F.avg((c("h") * c("h") + miss * miss - c("k")) / (c("k") * (c("k") - 1))).alias("p"), F.avg(c("h") / c("k")).alias("q"))
    e = c("q") * c("q") + (1 - c("q")) * (1 - c("q"))
    return x.select(F.round((c("p") - e) / (1 - e), 9).alias("kappa"))


@query
def t16_spearman(spark, folder):
    """Correlation of mid-ranks of confidence and line, ranked without a task for a whole tool."""
    rows = found(spark, folder).where("conf IS NOT NULL AND line IS NOT NULL").select("finding_id", "tool", "conf", "line")
    ranks = mid_ranks(mid_ranks(rows, ["tool"], "conf", "ra"), ["tool"], "line", "rb")
    return ranks.groupBy("tool").agg(F.round(F.corr("ra", "rb"), 9).alias("rho"))


@query
def t18_cohorts(spark, folder):
    rows = placed(spark, folder).where("cve IS NOT NULL").groupBy("rkey", (c("cve") < "CVE-2034").alias("early")).agg(F.max(flag(c("in_file"))).alias("hit"))
    return rows.groupBy("early").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("hit"), 9).alias("rate"))


@query
def t19_log_fit(spark, folder):
    rows = table(spark, folder, "parser_coverage").where("parsed_bytes > 0 AND total_php_files > 0").select(F.log(c("parsed_bytes").cast("double")).alias("y"), F.log(c("total_php_files").cast("double")).alias("x"))
    return rows.agg(F.round(F.regr_slope("y", "x"), 7).alias("slope"), F.round(F.regr_intercept("y", "x"), 7).alias("intercept"), F.round(F.regr_r2("y", "x"), 7).alias("r2"), F.count(F.lit(1)).alias("n"))


@query
def t21_orders(spark, folder):
    rates = placed(spark, folder).groupBy("tool").agg(F.round(F.avg(flag(c("in_file"))), 9).alias("rate"))
    return rates.withColumn("place", F.rank().over(Window.orderBy(F.desc("rate"))))  # one row for each tool


@query
def t22_line_arms(spark, folder):
    """Findings on a changed line under five ways to choose the denominator."""
    arms = {"all": F.lit(True), "anchored": c("distance").isNotNull(), "in file": c("in_file"), "in callable": c("same_callable"), "modified": c("in_file") & c("distance").isNotNull()}
    rows = placed(spark, folder).withColumn("arm", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in arms.items()]))))
    return rows.groupBy("arm", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("distance") == 0).alias("exact"))


@query
def t23_transitions(spark, folder):
    """Rungs given the file, and how much each rung loses against the one before."""
    n = placed(spark, folder).groupBy("tool").agg(F.count_if("in_file").alias("f"), F.count_if("in_hunk").alias("h"), F.count_if(c("distance") <= 5).alias("d"), F.count_if("same_callable").alias("s"))
    return n.select("tool", rate(c("h"), c("f")).alias("hunk_given_file"), rate(c("d"), c("f")).alias("near_given_file"), rate(c("s"), c("f")).alias("callable_given_file"), (c("f") - c("d")).alias("lost_near"), (c("f") - c("s")).alias("lost_callable"))


@query
def t24_brackets(spark, folder):
    hit = flag(c("in_file"))
    return placed(spark, folder).agg(
        F.round(F.avg(F.when(c("cls").isNotNull(), hit)), 9).alias("excluded"), F.round(F.avg(flag(c("cls").isNotNull() & c("in_file"))), 9).alias("failed"),
        F.round(F.avg(flag(c("cls").isNull() | c("in_file"))), 9).alias("passed"))


@query
def t25_completed_pairs(spark, folder):
    rows = placed(spark, folder).groupBy("rkey").agg(
        F.max(flag((c("tool") == "wpt") & c("in_file"))).alias("a"), F.max(flag((c("tool") == "progpilot") & c("in_file"))).alias("b"),
        F.bool_or((c("tool") == "wpt") & c("conf").isNotNull()).alias("x"), F.bool_or((c("tool") == "progpilot") & c("conf").isNotNull()).alias("y"))
    return rows.where("x AND y").agg(F.count(F.lit(1)).alias("records"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(c("a") > c("b")).alias("only_a"), F.count_if(c("b") > c("a")).alias("only_b"))


@query
def t26_failure_arms(spark, folder):
    """Findings without a confidence stand for failed runs: kept as they are, counted as misses, or left out."""
    rows, ok = placed(spark, folder), c("conf").isNotNull()
    arm = lambda name, n, hits: rows.agg(F.lit(name).alias("arm"), F.count_if(n).alias("n"), F.count_if(hits).alias("hits"))
    return arm("kept", F.lit(True), c("in_file")).unionByName(arm("miss", F.lit(True), c("in_file") & ok)).unionByName(arm("excluded", ok, c("in_file") & ok))


@query
def t27_three_arms(spark, folder):
    return per_record(placed(spark, folder), "wpt", "progpilot", "semgrep").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("records"))


# assertions


@query
def q01_host_failures(spark, folder):
    """Whether archive errors pass one in a hundred, over all and by the tenths of release sizes."""
    rows = table(spark, folder, "parser_coverage")
    return rows.agg(F.count(F.lit(1)).alias("releases"), F.sum("zip_errors").alias("errors"), (F.coalesce(F.sum("zip_errors") / F.sum("zips"), F.lit(0.0)) > 0.01).alias("refused"))


@query
def q02_leaks(spark, folder):
    """Cells that tell a tool or a rule: over all text columns of findings, unpivoted."""
    rows = table(spark, folder, "findings", "finding_id", "message", "source", "sink", "entry_point").unpivot("finding_id", ["message", "source", "sink", "entry_point"], "cell", "value")
    low = F.lower("value")
    leak = F.when(low.rlike("(^|[^a-z0-9_])(semgrep|progpilot|wpt)($|[^a-z0-9_])"), "tool").when(low.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+){2,}$"), "rule")
    return rows.where(leak.isNotNull()).groupBy("cell", leak.alias("leak")).agg(F.count_distinct("finding_id").alias("findings"))


@query
def q03_orphans(spark, folder):
    """Sampled identifiers, digits only, that no finding has."""
    digits = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "^urn:uuid:", ""), "[^0-9a-f]", "")
    asked = table(spark, folder, "study_sample", "finding_uid").where("finding_uid IS NOT NULL").select(digits("finding_uid").alias("uid")).distinct()
    return asked.join(table(spark, folder, "findings", "finding_uid").select(digits("finding_uid").alias("uid")), "uid", "left_anti")


@query
def q04_distinct_reasons(spark, folder):
    n = found(spark, folder).groupBy("tool").agg(F.count_distinct("message").alias("reasons"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", rate(c("reasons"), c("n")))


@query
def q05_drift(spark, folder):
    shipped = table(spark, folder, "parser_coverage").where("record_id IS NOT NULL").groupBy("record_id").agg(F.max("slug").alias("slug"), F.max("total_php_files").alias("shipped"))
    counted = table(spark, folder, "source_files", "record_id", "path").where(F.lower("path").endswith(".php")).groupBy("record_id").agg(F.count(F.lit(1)).alias("counted"))
    return shipped.join(counted, "record_id").where(~c("shipped").eqNullSafe(c("counted"))).select("slug", "shipped", "counted")


@query
def q06_disputed(spark, folder):
    return _pairs(spark, folder).where("a <> b").groupBy("slug", "path", "line").agg(F.min("a").alias("a"), F.min("b").alias("b"))


@query
def q07_reconciled(spark, folder):
    said = lambda tool: F.min(F.when(c("tool") == tool, c("cls")))
    rows = found(spark, folder).groupBy("slug", "path", "line").agg(said("wpt").alias("a"), said("progpilot").alias("b"), said("semgrep").alias("r"))
    return rows.where("coalesce(a, b, r) IS NOT NULL").select("slug", "path", "line", F.when(c("a") == c("b"), c("a")).otherwise(c("r")).alias("cls"))


@query
def q08_totals(spark, folder):
    """Totals derived by tool, by class and by plugin against the number of findings counted alone."""
    rows = found(spark, folder)
    derived = [rows.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(k).alias("by"), F.sum("n").alias("derived")) for k in ("tool", "cls", "slug")]
    published = F.broadcast(table(spark, folder, "findings", "finding_id").agg(F.count_distinct("finding_id").alias("published")))  # one row
    return derived[0].unionByName(derived[1]).unionByName(derived[2]).crossJoin(published).withColumn("agrees", c("derived") == c("published"))


@query
def q10_stamp(spark, folder):
    return found(spark, folder).groupBy("run_uid", "tool").agg(F.count(F.lit(1)).alias("findings"), F.min("scanned_at").alias("first_scan"), F.max("scanned_at").alias("last_scan"))


@query
def q11_failure_policy(spark, folder):
    return table(spark, folder, "parser_coverage").select("record_id", F.when(c("zip_errors") > 0, "error").when(c("files_with_error") > 0, "non_converged").alias("reason"))


@query
def q13_same_records(spark, folder):
    """Records that each two tools share: a record's tools are a small set, whose pairs are counted."""
    sets = found(spark, folder).where("rkey IS NOT NULL").groupBy("rkey").agg(F.array_sort(F.collect_set("tool")).alias("t"))
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
