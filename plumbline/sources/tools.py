"""Results of other analysers, brought to one form: path, line, classes, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text

SEVERITY = {"ERROR": 3, "WARNING": 2, "INFO": 1}
#: Weight of the access that a finding needs.
ACCESS = {"unauthenticated": 1000, "permission_callback": 700, "nonce_only": 600, "authenticated": 400, "unknown": 200, "capability_checked": 50}

PATTERN_SCHEMA = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>"
LIST_SCHEMA = "array<struct<vuln_name:string,sink_file:string,sink_line:int,source_file:string,source_line:int>>"
TRACE = "struct<path:string,line:int,snippet:string>"
TRACE_SCHEMA = f"results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<context:struct<access:string>,stored_write_context:struct<access:string>,dataflow_trace:struct<source:{TRACE},sink:{TRACE}>>>>"


def weight(access: Column) -> Column:
    out = F.lit(100)
    for k, v in ACCESS.items():
        out = F.when(access == k, F.lit(v)).otherwise(out)
    return out


# Classes of rules by their whole name, then by the first phrase that occurs in it.
RULE_CLASS = {
    "tainted-sql-string": ("sqli",), "wp-reflected-xss-direct-request-output": ("xss",), "wp-stored-xss-persistent-read-to-output": ("xss",), "stored-xss": ("xss",),
    "path-transversal": ("lfi",), "request-path-read-delete": ("lfi",), "unsafe-deserialization": ("deserial",), "unsafe-use": ("rce",), "render-callback-execution": ("rce",),
    "wp-open-redirect": ("other",), "wp-header-injection": ("other",), "wp-request-sensitive-action-without-cap-check": ("auth",), "wp-ajax-financial-action-without-cap-check": ("auth",),
    "wp-request-record-read-to-output-without-cap-check": ("auth",), "wp-request-file-delete-without-cap-check": ("auth",), "wp-request-tainted-privilege-mutation": ("auth",),
    "wp-request-file-upload-without-cap-check": ("auth", "upload"), "upload-api-surface": ("upload",), "wordpress-upload-helper-surface": ("upload",), "wp-rest-token-issuance-surface": ("auth",),
}
RULE_PHRASES = (
    ("sqli", ("sql",)), ("xss", ("xss", "output")), ("deserial", ("deserial", "unserialize")), ("upload", ("upload",)),
    ("auth", ("cap", "auth", "privilege")), ("lfi", ("path", "file", "include")), ("rce", ("callback", "unsafe-use", "exec")),
)
# Points that the snippets of a rule's trace give: (rules, snippet, words of which one must occur, words of which one must
# occur besides, points). Of entries with the same rules and a name only the first that applies counts.
OUTPUTS = ("wp-request-record-read-to-output-without-cap-check", "wp-stored-xss-persistent-read-to-output")
FILES = ("wp-request-file-delete-without-cap-check", "request-path-read-delete", "path-transversal")
POINTS = (
    (("render-callback-execution",), "source", ("apply_filters(", "apply_filters_ref_array("), (), 160),
    (("render-callback-execution",), "source", ("prepare_post_data(", "stripslashes_deep($_post['data'])", "stripslashes_deep( $_post['data'] )"), (), 48),
    (("wp-request-tainted-privilege-mutation",), "source", ("json_decode(",), ("$_post", "$_request"), 96),
    (("wp-request-tainted-privilege-mutation",), "source", ("new_role", "['role']", '"role"'), (), 72),
    (("wp-request-tainted-privilege-mutation",), "source", ("file_get_contents(",), ("$_files",), -64),
    (OUTPUTS, "sink", ("preg_replace(",), (), 160), (OUTPUTS, "sink", ("call_user_func(", "call_user_func_array("), (), 144),
    (OUTPUTS, "sink", ("<?php echo $", "echo $", "<?= $", "print $"), (), 112), (OUTPUTS, "sink", ('href="<?php echo', 'src="<?php echo', 'title="<?php echo'), (), 48),
    (OUTPUTS, "sink", ("esc_url(", "esc_attr("), (), 24), (OUTPUTS, "sink", ("esc_html(", "number_format_i18n("), (), -16),
    (FILES, "source", ("file_path", "tmp_name", "filepath"), (), 96), (FILES, "source", ("path", "file"), (), 40), (FILES, "source", ("text",), (), -24),
)


def rule_classes(rule: str) -> Column:
    """Sorted classes of a rule's name: of the whole name, else of the first phrase in it, else ``other``."""
    out = F.array(text.cascade(rule, RULE_PHRASES))
    for k, v in RULE_CLASS.items():
        out = F.when(F.col(rule) == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def points(rule: Column, trace: Column) -> Column:
    """What a rule's snippets and paths add to the weight of its access."""
    snippet = {side: F.lower(F.coalesce(trace[side]["snippet"], F.lit(""))) for side in ("source", "sink")}

    def holds(side: str, words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(snippet[side], F.lit(w))
        return out

    total = F.lit(0)
    for rules, side, words, besides, n in POINTS:
        both = holds(side, words) & (holds(side, besides) if besides else F.lit(True))
        total = total + F.when(rule.isin(*rules) & both, n).otherwise(0)
    filters = holds("source", POINTS[0][2])
    total = total + F.when((rule == "render-callback-execution") & ~filters & holds("source", ("apply_filters_deprecated(",)), 80).otherwise(0)
    total = total + F.when((rule == "unsafe-deserialization") & F.trim(snippet["source"]).startswith("function "), -128).otherwise(0)
    a, b = F.coalesce(trace["source"]["path"], F.lit("")), F.coalesce(trace["sink"]["path"], F.lit(""))
    return total + F.when((rule == "path-transversal") & (a != "") & (b != "") & (a != b), 32).otherwise(0)


def below_top(path: Column) -> Column:
    """Path below the archive's top directory, without empty and dot components."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(parts), "/")


def pattern_scanner(raw: DataFrame, body: str = "body") -> DataFrame:
    """(record, rank, path, line, cls) of a scanner's JSON: severest first, else as reported. Unreadable JSON: one row with ``fault``."""
    parsed = raw.withColumn("j", F.from_json(body, PATTERN_SCHEMA))
    rows = parsed.select("record", F.posexplode_outer("j.results").alias("pos", "r"), F.col("j.results").isNull().alias("fault"))
    level = F.coalesce(*[F.when(F.col("r.extra.severity") == k, v) for k, v in SEVERITY.items()], F.lit(0))
    rows = rows.select("record", "fault", "pos", level.alias("level"), below_top(F.col("r.path")).alias("path"), F.col("r.start.line").alias("line"), F.col("r.check_id").alias("rule"))
    rows = rows.withColumn("cls", text.tool_class("rule"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("level"), "pos"))).drop("level", "pos")


def list_scanner(raw: DataFrame, body: str = "body") -> DataFrame:
    """The same of a scanner that prints prose before a JSON list, in the order of emission."""
    cut = F.regexp_extract(body, r"(?s)(\[.*)$", 1)
    rows = raw.select("record", F.posexplode_outer(F.from_json(cut, LIST_SCHEMA)).alias("pos", "r"))
    rows = rows.select("record", F.col("r").isNull().alias("fault"), below_top(F.col("r.sink_file")).alias("path"), F.col("r.sink_line").alias("line"), F.col("r.vuln_name").alias("rule"), (F.col("pos") + 1).alias("rank"))
    return rows.withColumn("cls", text.tool_class("rule"))


def access_scorer(raw: DataFrame, body: str = "body") -> DataFrame:
    """The same of a tracing scanner, by the weight of the access it found; the sink's location comes before the start."""
    rows = raw.select("record", F.posexplode_outer(F.from_json(body, TRACE_SCHEMA).getField("results")).alias("pos", "r"))
    a, b = weight(F.coalesce("r.extra.context.access", F.lit(""))), weight(F.coalesce("r.extra.stored_write_context.access", F.lit("")))
    score = F.when(F.col("r.extra.stored_write_context.access").isNotNull(), F.greatest(a, b)).otherwise(a) - F.when(F.col("r.check_id").endswith("-surface"), 150).otherwise(0)
    score = score + points(F.coalesce("r.check_id", F.lit("")), F.col("r.extra.dataflow_trace"))
    sink = F.col("r.extra.dataflow_trace.sink")
    rows = rows.select("record", "pos", F.col("r").isNull().alias("fault"), below_top(F.coalesce(sink["path"], F.col("r.path"))).alias("path"), F.coalesce(sink["line"], F.col("r.start.line")).alias("line"), F.col("r.check_id").alias("rule"), score.alias("score"))
    return rows.withColumn("classes", rule_classes("rule")).withColumn("cls", F.col("classes")[0]).withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("score"), "pos"))).drop("pos")
