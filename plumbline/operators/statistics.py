"""Resampling, exact tests and their corrections, with draws that depend on hashes alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rank import even_rank


def draw(*parts: Column) -> Column:
    """A pseudo-random number of 0 to 2^60 - 1 from the parts, the same in any engine: the first 15 digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def clusters(rows: DataFrame, cluster: str, measures: dict[str, Column]) -> DataFrame:
    """One row for each cluster with the sums of the measures, ``n`` and ``i``, its number from 0 in the clusters' order.

    Resampling works on this table of clusters, never on rows: what follows grows with clusters x replicates.
    """
    sums = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("double").alias(k) for k, c in measures.items()])
    return even_rank(sums, [], [F.col(cluster)], "i").withColumn("i", F.col("i") - 1)


def resampled(table: DataFrame, measures: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(rep, n, sums): clusters drawn with replacement, as many as there are, in every replicate.

    Draw number ``slot`` of replicate ``rep`` takes cluster ``md5(seed|rep|slot) mod clusters``. The replicates
    are spread over the tasks with the slots; sums are formed in each task before the shuffle.
    """
    spark = table.sparkSession
    k = table.agg(F.max("i")).first()[0]
    count = 0 if k is None else int(k) + 1
    slots = spark.range(replicates * count).select((F.col("id") / max(count, 1)).cast("long").alias("rep"), (F.col("id") % max(count, 1)).alias("slot"))
    taken = slots.withColumn("i", (draw(F.lit(seed), "rep", "slot") % max(count, 1)).cast("int"))
    return taken.join(table.select("i", "n", *measures), "i").groupBy("rep").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])


def drawn_clusters(names: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(rep, cluster): the clusters of every replicate, drawn with replacement as in ``resampled``, for measures that need more than sums."""
    numbered = clusters(names, cluster, {}).select("i", cluster)
    spark = names.sparkSession
    k = numbered.agg(F.max("i")).first()[0]
    count = 0 if k is None else int(k) + 1
    slots = spark.range(replicates * count).select((F.col("id") / max(count, 1)).cast("long").alias("rep"), (F.col("id") % max(count, 1)).alias("slot"))
    return slots.withColumn("i", (draw(F.lit(seed), "rep", "slot") % max(count, 1)).cast("int")).join(numbered, "i").select("rep", cluster)


def unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``; an error if a key occurs twice."""
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} occurs more than once")
    return rows


def verdict(low: Column, high: Column, margin: float) -> Column:
    """What an interval of a difference tells, uncorrected for other tests."""
    return F.when((low > 0) | (high < 0), "excludes_zero_uncorrected").when((low >= -margin) & (high <= margin), "within_margin").otherwise("unresolved")


def interval(reps: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Percentile interval of a value over replicates; undefined replicates drop out and are counted."""
    v = reps.select(value.alias("v"))
    return v.agg(
        F.round(F.percentile("v", F.lit(0.025)), 9).alias(f"{name}_low"), F.round(F.percentile("v", F.lit(0.975)), 9).alias(f"{name}_high"),
        F.count("v").alias("defined"), (F.count(F.lit(1)) - F.count("v")).alias("undefined"),
        F.round(F.least(F.lit(1.0), 2 * F.least(F.avg(F.when(F.col("v") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("v") >= 0, 1.0).otherwise(0.0)))), 9).alias("p"),
    )


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p: twice the tail of Binomial(b + c, 1/2), at most 1; 1 where nothing is discordant.

    The fold keeps the logarithm of the current term, which would be 0 as a double from 1075 records on, and the
    tail's sum in units of that term, which lies between 1 and its number of terms.
    """
    n, k = (b + c).cast("double"), F.least(b, c)
    start = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        ratio = (n - i + 1) / i
        return F.struct((acc["log"] + F.log(ratio)).alias("log"), (1.0 + acc["sum"] / ratio).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda acc: F.exp(acc["log"] + F.log(acc["sum"])))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def sign_flip(differences: DataFrame, value: str = "d") -> DataFrame:
    """(n, observed, p): exact two-sided sign-flip test of integer differences.

    The distribution of the flipped sum is a convolution over the differences: the fold keeps one array over the
    sums from -total to total. Only distinct sizes with their numbers are collected, which are fewer than the
    square root of twice the total. Zero differences don't matter.
    """
    kept = differences.where(F.col(value) != 0).select(F.col(value).cast("long").alias("d"))
    each = kept.groupBy(F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("m"), F.sum("d").alias("s"))
    sizes = each.agg(F.array_sort(F.collect_list(F.struct("a", "m"))).alias("a"), F.sum("s").alias("observed"), F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y["a"] * y["m"]).cast("int")
    start = F.transform(F.sequence(F.lit(0), 2 * F.col("total")), lambda i: F.when(i == F.col("total"), 1.0).otherwise(0.0))

    def flip(p: Column, a: Column) -> Column:
        return F.transform(p, lambda _, i: 0.5 * (F.coalesce(F.get(p, (i - a).cast("int")), F.lit(0.0)) + F.coalesce(F.get(p, (i + a).cast("int")), F.lit(0.0))))

    def step(p: Column, y: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), y["m"]), p, lambda q, _: flip(q, y["a"]))

    done = sizes.withColumn("total", total).withColumn("p", F.aggregate("a", start, step))
    tail = F.aggregate(F.transform(F.col("p"), lambda x, i: F.when(F.abs(i - F.col("total")) >= F.abs("observed"), x).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    return done.select("n", F.coalesce("observed", F.lit(0)).alias("observed"), F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.least(tail, F.lit(1.0)), 12)).alias("p"))


def holm(tests: DataFrame, p: str = "p", order: Sequence[str] = ()) -> DataFrame:
    """``tests`` with ``holm``: the running maximum of min(1, (m - i) p) in the order of p."""
    by = Window.orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raw = tests.withColumn("__q", F.least(F.lit(1.0), (m - F.row_number().over(by) + 1) * F.col(p)))
    return raw.withColumn("holm", F.round(F.max("__q").over(by.rowsBetween(Window.unboundedPreceding, 0)), 12)).drop("__q")


def allocate(strata: DataFrame, size: str, total: int, name: Sequence[str]) -> DataFrame:
    """``strata`` with ``take``: one place each, the others in proportion to the sizes less one, by largest remainders (ties by name).

    No stratum gets more than it holds; as what is left is dealt in proportion to what a stratum has beyond its
    first, that only matters if all together hold less than ``total``, and then each gives all. More strata than
    places are an error. Strata are few; empty ones take no part.
    """
    rows, every = strata.where(F.col(size) > 0), Window.partitionBy()
    if rows.count() > total:
        raise ValueError("more strata than places")
    k, all_ = F.count(F.lit(1)).over(every), F.sum(size).over(every)
    share = rows.withColumn("__q", (F.col(size) - 1) / F.greatest(all_ - k, F.lit(1)) * (F.lit(total) - k)).withColumn("__left", F.lit(total) - k - F.sum(F.floor("__q")).over(every))
    place = F.row_number().over(Window.orderBy(F.round(F.col("__q") - F.floor("__q"), 9).desc(), *name))
    more = F.when(place <= F.col("__left"), 1).otherwise(0)
    return share.withColumn("take", F.least(F.col(size), 1 + F.floor("__q") + more).cast("long")).drop("__q", "__left")
