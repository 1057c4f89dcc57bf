"""Plugins as archives or folders, read into one row for each file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text

FILES = "archive string, path string, content string, n_bytes long, fault string"


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name, data in zip(b["path"], b["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            raw = z.read(info)
                            rows.append((name, info.filename, raw.decode("utf-8", "replace"), len(raw), None))
            except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
                rows.append((name, None, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["archive", "path", "content", "n_bytes", "fault"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all ``.zip`` archives below a folder; one that cannot be opened gives one row with its fault."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    return raw.select("path", "content").mapInPandas(_unpack, FILES)


def read_folder(spark: SparkSession, folder: str, glob: str = "*.php") -> DataFrame:
    """Files below a folder whose names match."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return raw.select(F.lit(folder).alias("archive"), F.col("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes"), F.lit(None).cast("string").alias("fault"))


def plugins(files: DataFrame) -> DataFrame:
    """One row for each archive with PHP files: slug (its name without ending and version), name, version, number of files.

    Name and version are those of the first file, by path, whose first 4096 characters have a header.
    """
    php = files.where(F.col("path").endswith(".php")).withColumn("h", F.substring("content", 1, 4096))
    first = Window.partitionBy("archive").orderBy("path")
    heads = php.where(F.col("h").rlike(text.HEADER_NAME)).withColumn("n", F.row_number().over(first)).where("n = 1")
    named = heads.select("archive", text.header("h", "Plugin Name").alias("name"), text.header("h", "Version").alias("version"))
    base = F.regexp_replace(F.regexp_extract("archive", r"([^/\\]+?)(?:\.zip)?/?$", 1), r"[._-]?v?\d[\d.]*$", "")
    return php.groupBy("archive").agg(F.count(F.lit(1)).alias("php_files")).withColumn("slug", base).join(named, "archive", "left").withColumn("name", F.coalesce("name", "slug"))


def enumerated(files: DataFrame, limit: int | None = None) -> DataFrame:
    """The plugins of ``plugins``, in the order of their archives' names and numbered from 1; ``limit`` counts only those that could be loaded."""
    from plumbline.operators.rank import even_rank

    numbered = even_rank(plugins(files.where("fault IS NULL")), [], [F.col("archive")], "n")
    return numbered if limit is None else numbered.where(F.col("n") <= limit)


def with_manifest(records: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("slug", "cve")) -> DataFrame:
    """Records with their manifest's columns, which win; blank or repeated keys and unknown manifest rows are errors."""
    blank = records.where(" OR ".join(f"{k} IS NULL OR trim({k}) = ''" for k in keys)).limit(1).count()
    twice = records.groupBy(*keys).count().where("count > 1").limit(1).count() + manifest.groupBy(*keys).count().where("count > 1").limit(1).count()
    extra = manifest.join(records, list(keys), "left_anti").limit(1).count()
    if blank or twice or extra:
        raise ValueError("blank keys" if blank else "repeated keys" if twice else "the manifest names records that don't exist")
    shared = [c for c in records.columns if c in manifest.columns and c not in keys]
    m = manifest.select(*keys, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in manifest.columns if c not in keys])
    out = records.join(m, list(keys), "left")
    for c in shared:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out
