"""Reproducible sample that stays as data grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import hex_long, uuid_hex
from plumbline.sources.tables import table

ROUNDS = 6


def feistel(df: DataFrame, high: str, low: str, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with its columns ``high`` and ``low`` (two signed longs) permuted as one 128-bit identifier.

    A Feistel network with a keyed 64-bit hash: one-to-one for every seed, without state, computed in the JVM.
    Every round is a projection of its own, so that each hash is computed once. Null halves give nulls.
    """
    for i in range(rounds):
        mixed = F.col(high).bitwiseXOR(F.xxhash64(F.lit(seed * 1000 + i).cast("long"), F.col(low)))
        df = df.withColumns({high: F.col(low), low: mixed})
    return df


def stable_sample(df: DataFrame, uid: str, rate: float, seed: int = 42, earlier: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` with a UUID, and whether they are selected.

    Added columns: ``slot_high`` and ``slot_low`` (the permuted identifier), ``by_rate`` (it lies under rate x
    2^128, so about that share of identifiers is drawn whatever else is in the table), ``by_earlier`` (the
    column ``uid`` of ``earlier`` names the identifier, in any notation) and ``selected``, either of these.
    The answer for a row depends on its identifier alone: not on order, partitions, repetition or other rows.
    Rows whose identifier is null or no UUID are left out. ``rate`` 0 selects nothing, 1 all. Empty tables
    give empty results. Identifiers of ``earlier`` go through the same permutation, and the join is on the
    permuted value, which is spread evenly whatever the identifiers look like.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")

    def slots(rows: DataFrame, c: str) -> DataFrame:
        hexa = uuid_hex(rows[c])
        rows = rows.withColumn("__hex", hexa).where("__hex IS NOT NULL")
        rows = rows.withColumns({"slot_high": hex_long(F.substring("__hex", 1, 16)), "slot_low": hex_long(F.substring("__hex", 17, 16))})
        return feistel(rows.drop("__hex"), "slot_high", "slot_low", seed)

    edge = int(rate * 2**64) - 2**63  # the signed form of rate x 2^64
    under = F.lit(True) if edge >= 2**63 else F.col("slot_high") < F.lit(edge).cast("long")
    out = slots(df, uid).withColumn("by_rate", under)
    if earlier is None:
        out = out.withColumn("by_earlier", F.lit(False))
    else:
        old = slots(earlier.select(F.col(uid)), uid).groupBy("slot_high", "slot_low").agg(F.lit(True).alias("by_earlier"))
        old = old.select(F.col("slot_high").alias("__h"), F.col("slot_low").alias("__l"), "by_earlier")
        # null-safe, though no slot is null: a plain equality would infer "is not null" filters and push them below
        # the rounds, where each unfolds into the whole permutation and is computed again
        same = F.col("slot_high").eqNullSafe(F.col("__h")) & F.col("slot_low").eqNullSafe(F.col("__l"))
        out = out.join(old, same, "left").drop("__h", "__l").withColumn("by_earlier", F.coalesce("by_earlier", F.lit(False)))
    return out.withColumn("selected", F.col("by_rate") | F.col("by_earlier"))


def sampled_findings(spark, folder: str, rate: float = 0.05) -> DataFrame:
    """Every finding's place in the sample, one row each."""
    rows = table(spark, folder, "findings", "finding_id", "finding_uid")
    return stable_sample(rows, "finding_uid", rate, earlier=table(spark, folder, "study_sample", "finding_uid"))
