"""Top N items within every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import label_key, path_key
from plumbline.sources.tables import table


def top_n(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], item: str, n: int = 3) -> DataFrame:
    """The ``n`` items of the highest ``score`` in every group, with their ``rank`` from 1.

    Order: score descending, then ``ties`` ascending (nulls first, as Spark sorts), then ``item``. Several rows
    that agree in all of these are one item. Rows with a null group column, null item, or a null or NaN score
    take no part. An empty table gives no rows; columns besides those named are dropped, so clashing names
    don't matter.

    The first pass ranks densely, so that repeated deliveries use up one place; both it and the numbering are
    rank filters over a window, which the optimiser's group limit prunes in each task before the shuffle and
    again after it: of a group with millions of rows a task sends on its own best n. The second pass numbers
    the few rows left and needs no further shuffle, being grouped alike.
    """
    keys, order = list(groups), [F.col(score).desc(), *[F.col(t).asc() for t in ties], F.col(item).asc()]
    names = ", ".join(f"`{k}`" for k in keys)
    by = f"`{score}` DESC, " + ", ".join(f"`{t}` ASC" for t in [*ties, item])
    rows = df.select(*keys, score, *ties, item).where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    spark = df.sparkSession
    few = spark.sql(f"SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY {names} ORDER BY {by}) AS __place FROM {{rows}}) WHERE __place <= {int(n)}", rows=rows)
    once = few.groupBy(*keys, score, *ties, item).agg(F.min("__place").alias("__place"))
    ranked = spark.sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY {by}) AS `rank` FROM {{once}}) WHERE `rank` <= {int(n)}", once=once)
    return ranked.drop("__place")


def classed(findings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Findings with ``cls``, the class their label means; those without one are left out.

    ``aliases`` is a fixed table of a few dozen names; the join is left to the optimiser, which knows its size.
    """
    names = aliases.select(F.col("alias").alias("__alias"), F.col("vuln_class").alias("cls")).where("cls IS NOT NULL").dropDuplicates(["__alias"])
    return findings.join(names, label_key(findings["vuln_class"]) == F.col("__alias")).drop("__alias")


def top_findings(spark, folder: str, n: int = 3) -> DataFrame:
    """The best ``n`` findings of every plugin, file and class."""
    rows = table(spark, folder, "findings", "finding_id", "slug", "file", "line", "vuln_class", "confidence")
    rows = classed(rows, table(spark, folder, "class_aliases"))
    rows = rows.select("finding_id", "slug", path_key("file").alias("path"), "cls", "line", "confidence")
    return top_n(rows, ["slug", "path", "cls"], "confidence", ["line"], "finding_id", n)
