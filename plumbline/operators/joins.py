"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 8, how: str = "left", merge: bool = False) -> DataFrame:
    """``left`` with the columns of ``right``, whose ``key`` is unique.

    Each row of ``right`` is repeated ``salts`` times and the rows of a hot key of ``left`` are dealt out by
    ``spread``, so no task gets more than one part in ``salts`` of them. Null keys find nothing.
    With ``merge`` nothing is broadcast: the optimiser's size check sees the files that ``right`` is read from, not
    its copies in memory, so a table of any size that passes it may fill the driver.
    """
    salt = "__salt"
    dealt = left.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge") if merge else copies, [key, salt], how).drop(salt)
