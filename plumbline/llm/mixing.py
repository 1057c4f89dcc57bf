"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pivotal import dealt, round_groups
from plumbline.session import stored


def plan(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """What each mix asks of each source and what the source can give.

    Adds to the targets: ``size`` of the source in tokens (0 if it has none), ``wanted`` = weight x budget,
    ``rate`` (copies of each of its texts: wanted / size, at most ``max_repeats``), ``given`` = rate x size and
    ``unmet``, true where wanted exceeds max_repeats x size. A null weight, budget or cap counts as 0; targets
    without a source stay, with size 0. Both tables are small: one row for each source or pair.
    """
    full = targets.join(sizes.select(F.col("source"), F.col("tokens").alias("size")), "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    full = full.withColumn("wanted", F.coalesce(F.col("target_weight") * F.col("budget_tokens"), F.lit(0.0)))
    cap = F.coalesce(F.col("max_repeats"), F.lit(0))
    full = full.withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.col("size"), cap.cast("double"))).otherwise(F.lit(0.0)))
    return full.withColumn("given", F.col("rate") * F.col("size")).withColumn("unmet", F.col("wanted") > cap * F.col("size"))


def mix(docs: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): the texts of every mix, ``copies`` of 1 or more.

    Every text of a source gets the whole copies of its rate; the fractions are rounded by the pivotal method
    inside each mix and source, so that the number of extra copies is right to the unit and never above the cap.
    Texts duel with texts of about their own length, so that the tokens are met closely, too. Texts are shuffled
    once, into slices; there they meet the mixes, whose table is small.
    """
    asked = stored(planned.where("rate > 0").select("mix_id", "source", "rate"), "mixes")
    parts = dealt(docs.select("doc_id", "source", "tokens"), ["doc_id"], seed, balance="tokens").join(asked, "source")
    parts = parts.select("mix_id", "source", "doc_id", "tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), "__slice")
    rounded = round_groups(parts, ["mix_id", "source"], "part", ["doc_id"], seed, balance="tokens")
    return rounded.select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("up")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Tokens and share that every source reached in every mix, beside what was asked.

    ``full`` tells that the source is used up: its tokens are those of all its texts, each as often as the cap
    allows. A source without texts, or with a cap of 0, is used up from the start.
    """
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    total = got.groupBy("mix_id").agg(F.sum("tokens").alias("__all"))
    full = planned.join(got, ["mix_id", "source"], "left").join(total, "mix_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.when(F.col("__all") > 0, F.col("tokens") / F.col("__all")).otherwise(F.lit(0.0))
    used = F.col("tokens") >= F.coalesce(F.col("max_repeats"), F.lit(0)) * F.col("size")
    return full.select("mix_id", "source", "target_weight", "wanted", "given", "unmet", "tokens", share.alias("share"), used.alias("full"))


def shortfalls(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_id, source) that the mix could not fill: used up, and still below what was asked."""
    return shares(mixed, planned).where("full AND wanted > tokens").select("mix_id", "source")
