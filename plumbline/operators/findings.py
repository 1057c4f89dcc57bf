"""Base tables of findings and patch geometry, in the forms that the other operators join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.keys import label_key, path_key, slug_key
from plumbline.operators.rank import even_rank
from plumbline.sources.tables import table

#: Weight of an entry point in the ranking of findings.
ENTRY_WEIGHT = {"ajax_nopriv": 5.0, "rest_api": 4.0, "shortcode": 3.0, "ajax_auth": 2.5, "admin": 1.0, "unknown": 0.5}
#: Priority of an entry point, the strongest first.
ENTRY_PRIORITY = {"ajax_nopriv": 1, "ajax_auth": 2, "rest_api": 3, "shortcode": 4, "admin": 5, "unknown": 9}


def keyed(values: dict, column: str, default) -> F.Column:
    """A constant lookup table as one expression."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def findings(spark, folder: str) -> DataFrame:
    """One row for each finding: its first delivery, with normalised path, class (null if it has none) and record key.

    Repeated deliveries collapse by ``finding_id``; a NaN confidence becomes null.
    """
    raw = table(spark, folder, "findings")
    first = Window.partitionBy("finding_id").orderBy("ingested_at", "file", "vuln_class")
    once = raw.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    names = table(spark, folder, "class_aliases").select(F.col("alias").alias("__alias"), F.col("vuln_class").alias("cls"))
    rows = once.join(names, label_key(once["vuln_class"]) == F.col("__alias"), "left")
    return rows.select(
        "finding_id", "finding_uid", "run_uid", "slug", "cve", "tool", "rank", path_key("file").alias("path"), "line", "cls", "message", "source", "sink", F.col("function").alias("fn"),
        F.col("interprocedural").alias("inter"), F.nanvl("confidence", F.lit(None).cast("double")).alias("conf"), F.col("entry_point").alias("ep"), F.col("guard_deficit").alias("deficit"), "scanned_at",
        F.concat("slug", F.lit("|"), F.coalesce("cve", F.lit("-"))).alias("rkey"))


def patches(spark, folder: str) -> DataFrame:
    """One row for each patched file; exact repetitions collapse."""
    rows = table(spark, folder, "patchmaps").dropDuplicates(["record_id"])
    return rows.select(F.col("record_id").alias("gid"), slug_key("slug").alias("slug"), "cve", path_key("path").alias("path"), "is_php", "status", "vuln_lines", "patched_lines", "changed_vuln_lines", "insertion_boundaries", "hunks", "callable_ranges", "top_level_changed_lines")


def changed_lines(patched: DataFrame) -> DataFrame:
    return patched.select("gid", F.explode("changed_vuln_lines").alias("line")).distinct()


def boundaries(patched: DataFrame) -> DataFrame:
    return patched.select("gid", F.explode("insertion_boundaries").alias("line")).distinct()


def hunks(patched: DataFrame) -> DataFrame:
    return patched.select("gid", F.explode("hunks").alias("h")).select("gid", F.col("h.start").alias("h_start"), F.col("h.end").alias("h_end"), F.col("h.kind").alias("h_kind")).distinct()


def callables(patched: DataFrame) -> DataFrame:
    return patched.select("gid", F.explode("callable_ranges").alias("r")).select("gid", F.col("r.s").alias("s"), F.col("r.e").alias("e")).distinct()


def exploitability(flow: float = 1.0, guard: float = 0.5, center: float = 0.0) -> F.Column:
    """Ranking key of a finding: entry weight, a point for crossing functions, confidence, and the guard deficit where it applies."""
    term = F.when(F.col("deficit") >= 0, F.lit(guard) * (F.col("deficit") - F.lit(center))).otherwise(F.lit(0.0))
    return keyed(ENTRY_WEIGHT, "ep", 0.5) + F.when(F.coalesce("inter", F.lit(False)), 1.0).otherwise(0.0) + F.lit(flow) * F.coalesce("conf", F.lit(0.6)) + F.coalesce(term, F.lit(0.0))


def ranked(rows: DataFrame, score: F.Column | None = None, even: bool = False) -> DataFrame:
    """``rows`` with ``score`` and ``rk``, the 1-based rank inside (record, tool); ties keep the tool's own order, then the id.

    The plain form is a window, which the optimiser prunes where only first ranks are asked for; ``even`` spreads
    hot groups over the tasks and is for full rankings; as it writes its rows, select the columns that are needed first.
    """
    scored = rows.withColumn("score", F.round(exploitability() if score is None else score, 9))
    if even:
        return even_rank(scored, ["rkey", "tool"], [F.desc("score"), F.col("rank"), F.col("finding_id")], "rk")
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy("rkey", "tool").orderBy(F.desc("score"), "rank", "finding_id")))
