"""Queries over the findings that the dataflow analysis makes of the source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.engine import scan
from plumbline.engine.cases import CASES
from plumbline.sources.tables import table

QUERIES: dict = {}
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
SQL: dict[str, str] = {"scan_cases": "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(name)}, {_quoted(found)})" for name, _, found in CASES) + ") AS t(name, findings)"}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark, folder):
    """Files with a PHP ending, one row for each release and path."""
    rows = table(spark, folder, "source_files", "record_id", "path", "content")
    return rows.where(F.lower("path").rlike(r"\.(php|inc|phtml)$"))


@query
def scan_sources(spark, folder):
    """Every finding of every release, ranked."""
    return scan.ranked(scan.scan(_files(spark, folder)))


@query
def scan_status(spark, folder):
    """How each release's analysis ended."""
    return scan.status(_files(spark, folder))


@query
def scan_classes(spark, folder):
    """Findings by class and entry point."""
    return scan.scan(_files(spark, folder)).groupBy("vuln_class", "entry_point").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def scan_convergence(spark, folder):
    """Releases by outcome: converged, capped, with unread statements, failed."""
    outcome = F.when(F.col("failed").isNotNull(), "failed").when(~F.col("converged"), "not_converged").when(F.col("errors") > 0, "partly_read").otherwise("converged")
    return scan.status(_files(spark, folder)).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("releases"), F.sum("findings").alias("findings"), F.max("rounds").alias("rounds"))


@query
def scan_cases(spark, folder):
    """The analysis of small plugins, one for each behaviour; the SQL states what must be found where."""
    rows = spark.createDataFrame([(name, "a.php", text) for name, text, _ in CASES], "name string, path string, content string")
    found = scan.scan(rows, key="name").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat("vuln_class", F.lit("@"), F.col("line").cast("string")).alias("f")))).alias("x"))
    return rows.select("name").join(found, "name", "left").select("name", F.coalesce(F.array_join(F.transform("x", lambda x: x["f"]), " "), F.lit("")).alias("findings"))
