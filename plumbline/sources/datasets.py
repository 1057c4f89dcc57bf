"""Datasets of advisories: tables of records with their archives, merged with checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file or folder with a header; a missing column is an error, all values are text, blank ones null."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])


def first_of_each(records: DataFrame, keys: Sequence[str], archives: Sequence[str], order: str) -> DataFrame:
    """The first record, by ``order``, of every key; an error if records of a key name different archives, or a key is blank.

    Archives are compared as a whole, nulls being equal to each other. The check and the choice are one aggregation.
    """
    pair, rest = F.struct(*archives), [c for c in records.columns if c not in keys]
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    one = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x"), (F.min(pair) != F.max(pair)).alias("__differs"), F.max(blank).alias("__blank"))
    bad = one.agg(F.count_if("__differs").alias("d"), F.count_if("__blank").alias("b")).first()
    if bad.b:
        raise ValueError("blank keys")
    if bad.d:
        raise ValueError(f"{bad.d} keys with different archives")
    return one.select(*keys, "x.*")


def resolved(names: DataFrame, listing: DataFrame, places: Sequence[str]) -> DataFrame:
    """``names`` (column ``archive``) with ``found``, its path in the first of ``places`` that has it, null if none does.

    ``listing``: (place, archive, path). Places are tried in their order.
    """
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(places))):
        rank = F.when(F.col("place").startswith(p), i).otherwise(rank)
    best = listing.withColumn("__r", rank).where("__r IS NOT NULL").groupBy("archive").agg(F.min(F.struct("__r", "path")).alias("x")).select("archive", F.col("x.path").alias("found"))
    return names.join(best, "archive", "left")
