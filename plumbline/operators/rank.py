"""Ranking inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored


def spread_rank(df: DataFrame, keys: Sequence[str], order: Column, out: str, buckets: int = 64, tie: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row in its group by a pseudo-random long, without one task per group.

    ``order`` must spread evenly over the longs (a hash); its top bits cut every group into ``buckets``
    slices that are ranked apart, and the slices' sizes are summed up in a table of groups x buckets rows.
    Rows equal in ``order`` and ``tie`` get distinct positions in an undefined order. Empty input gives no rows.
    """
    slot = F.shiftright(order, 40).bitwiseAND(F.lit((1 << 23) - 1))
    b, h, r, before = "__bucket", "__order", "__rank", "__before"
    sliced = df.withColumn(h, order).withColumn(b, (slot * buckets / (1 << 23)).cast("int"))
    inner = Window.partitionBy(*keys, b).orderBy(slot, h, *tie)
    sizes = sliced.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__b"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias(before))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    ranked = sliced.withColumn(r, F.row_number().over(inner)).join(sizes, [*on, F.col(b) == F.col("__b")])
    return ranked.withColumn(out, F.col(r) + F.col(before)).drop(b, h, r, before, "__b", *[f"__k{i}" for i in range(len(keys))])


def even_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, parts: int | None = None) -> DataFrame:
    """1-based position of each row in its group, in a given order, without one task for each group.

    Rows are range-partitioned by keys and order, so a hot group is cut into stretches of its own order; stretches
    are numbered apart, and the sizes of those before them are added. Nulls come where the order puts them; rows
    equal in keys and order get distinct positions in an undefined order. Without keys the whole table is one
    group. The partitioned rows are written to the shared folder, as they are read twice.
    """
    spark = df.sparkSession
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(k) for k in keys], *order]
    laid = stored(df.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), "ranked")
    local = laid.withColumn("__r", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    sizes = laid.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    on = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    return local.join(offsets, on).withColumn(out, F.col("__r") + F.col("__before")).drop("__part", "__r", "__p", "__before", *[f"__k{i}" for i in range(len(keys))])


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of each row's value in its group, equal values sharing the mean of their positions. Null values count as equal and least."""
    placed = even_rank(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m")), keys, [F.col(value)], "__i")
    # positions of distinct values are few; their sizes are summed up to positions of rows
    upto = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    mids = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), (F.coalesce(F.sum("__m").over(upto), F.lit(0)) + (F.col("__m") + 1) / 2.0).alias(out))
    on = [F.col(value).eqNullSafe(F.col("__v")), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    return df.join(mids, on, "left").drop("__v", *[f"__k{i}" for i in range(len(keys))])
