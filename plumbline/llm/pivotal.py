"""Pivotal rounding of fractional copy numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored

CLOSE = 1e-9
#: Slices of the first round and how many of them meet in the next; like the seed, they are part of what a draw is.
SLICES, FAN, BUCKETS = 1024, 32, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # fixed values: the mixing constants of splitmix64


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys and the salt alone."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + _A * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def duel(group: np.ndarray, p: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Fractions after pivotal duels: in each group all but one become 0 or 1, and the group's sum stays.

    Rows must be sorted by group. In a duel one unit hands mass to the other until one of the two is whole,
    with the odds that keep both expectations. All duels of a round run at once; a round halves what is left.
    """
    p = np.where(p < CLOSE, 0.0, np.where(p > 1 - CLOSE, 1.0, p.astype(float)))
    turn = 0
    while True:
        at = np.flatnonzero((p > 0) & (p < 1))
        if len(at) < 2:
            return p
        g = group[at]
        first = np.r_[True, g[1:] != g[:-1]]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        left = np.flatnonzero((place % 2 == 0) & np.r_[~first[1:], False])
        if not len(left):
            return p
        a, b = at[left], at[left + 1]
        s, u = p[a] + p[b], _uniform(key[a] ^ (key[b] >> 1), salt * 64 + turn)
        small = s < 1
        with np.errstate(divide="ignore", invalid="ignore"):
            wins = np.where(small, u * s < p[a], u * (2 - s) < 1 - p[b])
        high, low = np.where(small, s, 1.0), np.where(small, 0.0, s - 1)
        p[a], p[b] = np.where(wins, high, low), np.where(wins, low, high)
        p[at] = np.where(p[at] < CLOSE, 0.0, np.where(p[at] > 1 - CLOSE, 1.0, p[at]))
        turn += 1


def dealt(df: DataFrame, ident: Sequence[str], seed: int, slices: int = SLICES, balance: str | None = None) -> DataFrame:
    """``df`` shuffled into ``__slice``, a hash of the columns that name a unit.

    With ``balance`` slices are for units of about the same size (by powers of the root of two), so that the tree
    first joins slices of one size and then those of neighbouring sizes; as many as ``FAN`` sizes are told apart.
    Units that are multiplied afterwards (once for each plan or mix) by a join with a small table keep this
    layout, so ``round_groups`` needs no shuffle of the multiplied rows.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64(F.lit(seed), *ident)
    at = F.pmod(h, F.lit(slices))
    if balance and slices > FAN:
        step = F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(F.col(balance).cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)), F.lit(FAN - 1))
        at = step * (slices // FAN) + F.pmod(h, F.lit(slices // FAN))
    return df.withColumn("__slice", at.cast("int")).repartition(n, "__slice")


def _player(salt: int, last: bool, losers: bool):
    """Duels of one slice in one round of the tree."""

    def play(table: pa.Table) -> pa.Table:
        g, u, b, p = (table[c].to_numpy() for c in ("__g", "__u", "__b", "__p"))
        order = np.lexsort((u, b, g))
        g, u, p = g[order], u[order], p[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (u[1:] != u[:-1])][: len(g)]  # repeated rows are one unit
        q = duel(g[first], p[first], u[first], salt)
        if last:
            q = np.where((q > 0) & (q < 1), (_uniform(u[first], salt + 15) < q).astype(float), q)
        p = q[np.cumsum(first) - 1]
        out = table.take(pa.array(order)).set_column(table.column_names.index("__p"), "__p", pa.array(p, pa.float64()))
        return out if losers else out.filter(pa.array(p > 0))

    return play


def round_groups(df: DataFrame, groups: Sequence[str], part: str, ident: Sequence[str], seed: int, balance: str | None = None, outer: Sequence[str] = (), losers: bool = True, slices: int = SLICES, fan: int = FAN) -> DataFrame:
    """``df`` with ``up``, 0 or 1 for each row: the column ``part`` in [0, 1] rounded by the pivotal method.

    In every group of ``groups`` the rounded sum is the sum of the parts, rounded to one of the two integers
    beside it, and each row's expectation is its part. Rows are dealt to a fixed number of slices by a hash of
    ``ident`` (which names a row in its group) and duelled inside their slice; the one unit of a group that a
    slice leaves open goes on with those of ``fan`` slices to the next round of a tree, until one slice is left.
    No task gets a whole group, and a unit's draw depends neither on partitions nor on the number of rows.
    Units meet in the order of ``balance`` (a number; nulls count as 0), in slices and in the tree, so that mass
    moves between units of about the same size and sums of that number are met closely, too; without it they meet
    in the order of a hash.
    What is open in the end is duelled once more inside ``outer``, whose sums so stay right to one unit, and the
    last open unit is drawn by its own fraction. Null parts count as 0; rows that agree in groups and ident share
    one result. ``losers`` false leaves out rows that are not taken. An empty table gives none.
    """
    names = df.columns
    if "__slice" not in names:
        df = dealt(df, ident, seed, slices, balance)
    keep = [c for c in names if c != "__slice"]
    weight = F.coalesce(F.col(balance).cast("double"), F.lit(0.0)) if balance else F.lit(0.0)
    rows = df.select(
        *keep, "__slice", F.coalesce(F.col(part).cast("double"), F.lit(0.0)).alias("__p"), F.xxhash64(*groups).alias("__g"),
        F.xxhash64(F.lit(seed), *groups, *ident).alias("__u"), weight.alias("__b"))
    tree = [slices]
    while tree[-1] > 1:
        tree.append(max(1, tree[-1] // fan))
    rounds = [*tree, *([0] if outer else [])]  # 0: the units still open meet inside the outer groups
    done = []
    for level, n in enumerate(rounds):
        task = "__slice"
        if level:
            task = "__task"
            if n:
                at = F.floor(F.col("__slice") / (slices // n)) * BUCKETS
            else:
                rows, at = rows.withColumn("__g", F.xxhash64(*outer)), F.lit(0)
            rows = rows.withColumn(task, (at + F.pmod("__g", F.lit(BUCKETS))).cast("int"))
        play = _player(seed * 1024 + level * 16, level == len(rounds) - 1, losers)
        played = stored(rows.groupBy(task).applyInArrow(play, rows.schema), "pivotal").drop("__task")
        done.append(played.where("__p IN (0, 1)"))
        rows = played.where("__p NOT IN (0, 1)")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*keep, F.col("__p").cast("int").alias("up"))
