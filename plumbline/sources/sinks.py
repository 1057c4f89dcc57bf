"""Writers: reports, populations, sheets, and the vocabulary with its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a report tells of a finding, in this order.
REPORT = ("vuln_class", "file", "line", "source", "sink", "entry_point", "confidence", "message", "trace", "guard_deficit")


def write_report(found: DataFrame, path: str, key: str = "record_id") -> None:
    """One JSON document for each target: its findings in the order of their rank, their number and classes."""
    row = F.struct("rank", *REPORT)
    rows = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_set("vuln_class")).alias("classes"), F.array_sort(F.collect_list(row)).alias("findings"))
    rows.write.mode("overwrite").json(path)


def write_population(found: DataFrame, path: str) -> None:
    """One JSON line for each finding, nulls written out, so that every line has every field."""
    found.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by semicolons, as cells hold no lists."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def append_words(words: DataFrame, path: str) -> int:
    """Adds words (kind, name, cls) to the versioned vocabulary of a folder as its next version, only those it lacks; gives the version.

    Versions are folders that are never rewritten, so an older one can be read again.
    """
    spark = words.sparkSession
    known, version = read_words(spark, path), latest(spark, path) + 1
    fresh = words.select("kind", "name", "cls").distinct()
    if known is not None:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kind", "name", "cls")]
        fresh = fresh.alias("a").join(known.alias("b"), same, "left_anti")
    fresh.withColumn("version", F.lit(version)).write.parquet(f"{path.rstrip('/')}/v={version:06d}")
    return version


def latest(spark: SparkSession, path: str) -> int:
    """The latest version in a folder, 0 if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in files.listStatus(where)] if files.exists(where) else []
    return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)


def read_words(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All words up to a version, by default the latest; None if there is none."""
    last = latest(spark, path) if version is None else version
    folders = [f"{path.rstrip('/')}/v={v:06d}" for v in range(1, last + 1)]
    return spark.read.schema("kind string, name string, cls string, version int").parquet(*folders) if folders else None
