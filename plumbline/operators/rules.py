"""The analysis' vocabulary as a table, and rules for a pattern scanner made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import vocabulary as V


def vocabulary(spark: SparkSession) -> DataFrame:
    """(kind, name, cls): sources, sanitizers with the class they serve (null: all), sinks, guards."""
    rows = [("source", f"${x}", None) for x in V.SUPERGLOBALS] + [("source", x, None) for x in V.REQUEST_SOURCES | V.PERSISTENT_SOURCES]
    rows += [("sanitizer", x, None) for x in V.SANITIZERS] + [("sanitizer", x, c) for c, names in V.CLASS_SANITIZERS.items() for x in names]
    rows += [("sink", x, c) for x, c in V.SINK_OF.items()] + [("method_sink", x, "sqli") for x in V.SQL_METHODS]
    rows += [("nonce", x, "csrf") for x in V.NONCE] + [("capability", x, "auth") for x in V.CAPABILITY] + [("state_change", x, None) for x in V.STATE_CHANGES]
    return spark.createDataFrame(sorted(rows, key=str), "kind string, name string, cls string")


def compiled(words: DataFrame) -> DataFrame:
    """One rule for each class: (cls, rule as JSON) with its sources, sanitizers and sinks."""
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("name"))))
    classes = words.where("kind IN ('sink', 'method_sink')").select("cls").distinct()
    sinks = words.where("kind IN ('sink', 'method_sink')").groupBy("cls").agg(F.array_sort(F.collect_set("name")).alias("sinks"))
    shared = words.agg(pick(F.col("kind") == "source").alias("sources"), pick((F.col("kind") == "sanitizer") & F.col("cls").isNull()).alias("universal"))
    own = words.where("kind = 'sanitizer' AND cls IS NOT NULL").groupBy("cls").agg(F.collect_set("name").alias("own"))
    one = shared.first()
    full = classes.join(sinks, "cls").join(own, "cls", "left")
    clean = F.array_sort(F.array_union(F.lit(list(one["universal"])), F.coalesce("own", F.array().cast("array<string>"))))
    return full.select("cls", F.to_json(F.struct(F.lit(list(one["sources"])).alias("sources"), clean.alias("sanitizers"), "sinks")).alias("rule"))
