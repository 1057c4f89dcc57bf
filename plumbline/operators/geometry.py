"""Where findings lie in relation to a patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import slug_key


def scope(line: F.Column, ranges: F.Column) -> F.Column:
    """Innermost range around a line, the first of equally narrow ones; null outside all."""
    inside = F.filter(ranges, lambda r: (r["s"] <= line) & (line <= r["e"]))
    width = F.array_min(F.transform(inside, lambda r: r["e"] - r["s"]))
    return F.get(F.filter(inside, lambda r: (r["e"] - r["s"]) == width), 0)


def geometry(found: DataFrame, patched: DataFrame) -> DataFrame:
    """Each finding beside each patched file of its plugin and advisory that has its path, with all rungs.

    Findings outside patched files keep one row with null ``gid`` and every rung false; a file without changed
    lines (deleted, or only insertions) gives the file rung alone, and its distance is null.
    The join is an equi-join on plugin, advisory and path; the intervals of a file are compared inside its row.
    """
    f = found.withColumn("__slug", slug_key("slug"))
    g = patched.where("coalesce(is_php, true)").select("gid", F.col("slug").alias("__g"), F.col("cve").alias("__cve"), F.col("path").alias("__path"), "changed_vuln_lines", "insertion_boundaries", "hunks", "callable_ranges", "top_level_changed_lines")
    j = f.join(g, (F.col("__slug") == F.col("__g")) & F.col("cve").eqNullSafe(F.col("__cve")) & (F.col("path") == F.col("__path")), "left")
    changed = F.coalesce("changed_vuln_lines", F.array().cast("array<int>"))
    line = F.coalesce("line", F.lit(0))
    dist = F.when((F.size(changed) > 0) & (line > 0), F.array_min(F.transform(changed, lambda c: F.abs(line - c))))
    ranges = F.coalesce("callable_ranges", F.array().cast("array<struct<s:int,e:int>>"))
    own = scope(line, ranges)
    rungs = {
        "in_file": F.col("gid").isNotNull(),
        "distance": dist,
        "exact": F.array_contains(changed, line),
        "within2": F.coalesce(dist <= 2, F.lit(False)), "within5": F.coalesce(dist <= 5, F.lit(False)), "within10": F.coalesce(dist <= 10, F.lit(False)),
        "same_callable": (line > 0) & F.exists(changed, lambda c: scope(c, ranges).eqNullSafe(own)),
        "in_hunk": (line > 0) & F.coalesce(F.exists("hunks", lambda h: (h["start"] <= line) & (line <= h["end"])), F.lit(False)),
        "near_boundary": (line > 0) & F.coalesce(F.exists("insertion_boundaries", lambda b: (F.abs(line - b) <= 5) | (F.abs(line - (b + 1)) <= 5)), F.lit(False)),
        "at_top": F.col("gid").isNotNull() & (line > 0) & own.isNull(),
        "change_at_top": F.coalesce(F.size("top_level_changed_lines") > 0, F.lit(False)),
    }
    return j.withColumns(rungs).drop("__slug", "__g", "__cve", "__path", "changed_vuln_lines", "insertion_boundaries", "hunks", "callable_ranges", "top_level_changed_lines")


#: Implications that hold between rungs: the first must imply the second.
NESTING = (("exact", "in_file"), ("same_callable", "in_file"), ("in_hunk", "in_file"), ("within2", "in_file"), ("within5", "in_file"), ("within10", "in_file"), ("exact", "within2"), ("within2", "within5"), ("within5", "within10"))


def violations(rows: DataFrame) -> DataFrame:
    """(finding_id, gid, rule) for every implication a row breaks; none on sound geometry."""
    broken = F.filter(F.array(*[F.when(F.col(a) & ~F.col(b), F.lit(f"{a} without {b}")) for a, b in NESTING]), lambda x: x.isNotNull())
    return rows.select("finding_id", "gid", F.explode(broken).alias("rule"))


def rungs(rows: DataFrame, advised: str) -> DataFrame:
    """Four rungs by place alone, and the same where the finding's class is the advised one; the class never changes the place."""
    match = F.coalesce(F.col("cls") == F.col(advised), F.lit(False))
    place = {"file": F.col("in_file"), "callable": F.col("same_callable"), "exact_line": F.coalesce(F.col("distance") == 0, F.lit(False)), "proximity_5": F.col("within5")}
    return rows.select("finding_id", "gid", match.alias("class_match"), *[v.alias(f"geometric_{k}") for k, v in place.items()], *[(v & match).alias(f"class_{k}") for k, v in place.items()])
