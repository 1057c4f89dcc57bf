"""Analysis of one target: a file, an archive or a folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import scan
from plumbline.sources.archives import read_archives, read_folder


def files_of(spark: SparkSession, target: str) -> DataFrame:
    """(record_id, path, content) of a target; its name is its record. A target without PHP files gives no rows."""
    name = os.path.basename(target.rstrip("/"))
    if target.lower().endswith(".zip"):
        rows = read_archives(spark, target).where("path IS NOT NULL AND lower(path) LIKE '%.php'")
    elif target.lower().endswith((".php", ".inc", ".phtml")):
        rows = read_folder(spark, target, "*").withColumn("path", F.lit(name))
    else:
        rows = read_folder(spark, target).withColumn("path", F.regexp_extract("path", f"(?:^|/){_quoted(name)}/(.*)$", 1))
    return rows.select(F.lit(name).alias("record_id"), "path", "content")


def _quoted(name: str) -> str:
    return r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E"


def scan_target(spark: SparkSession, target: str, **options: bool) -> DataFrame:
    """Ranked findings of one target."""
    return scan.ranked(scan.scan(files_of(spark, target), **options))
