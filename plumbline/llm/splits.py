"""Splits that keep related records together."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import author_key, slug_key
from plumbline.operators.joins import salted_lookup
from plumbline.operators.rank import spread_rank
from plumbline.session import stored
from plumbline.sources.tables import table

SALTS = 8


def stars(keyed: DataFrame, node: str, key: str) -> DataFrame:
    """Edges (u, v) that connect all nodes sharing a key with the least of them, at most one for each row.

    The least nodes are found by partial sums in each task, and the rows of a hot key meet theirs in several tasks,
    so no task holds a whole key. Null keys and nodes link nothing.
    """
    rows = keyed.where(F.col(node).isNotNull() & F.col(key).isNotNull()).select(F.col(node).alias("u"), F.col(key).alias("k"))
    least = rows.groupBy("k").agg(F.min("u").alias("v"))
    return salted_lookup(rows, least, "k", F.xxhash64("u"), SALTS, "inner", merge=True).select("u", "v").where("u <> v").distinct()


def flat(hooks: DataFrame, name: str) -> DataFrame:
    """The (hi, lo) table of hooks shortcut until every ``lo`` hooks onto nothing; written to the shared folder.

    A pass looks every end up twice, so that ways shrink to a third, and is written once.
    """
    while True:
        up = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("__up"))
        jump = lambda df: salted_lookup(df, up, "lo", F.xxhash64("hi"), SALTS, merge=True).select("hi", F.coalesce("__up", "lo").alias("lo"), F.col("__up").isNotNull().alias("moved"))
        jumped = stored(jump(jump(hooks).drop("moved")), name)
        hooks, moved = jumped.select("hi", "lo"), jumped.where("moved").limit(1).count()
        if not moved:
            return hooks


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, root): the least node that each node is connected with, by hooking and shortcutting.

    Every node starts as its own root. In each round every root hooks onto the least neighbouring root below it,
    the hooks are shortcut by joining them with themselves until they are flat, and the edges are carried over to
    the roots of their ends. Rounds end when no edge joins two roots. A node hooks once, so the hooks of all rounds
    are one forest, which is shortcut in the end and met by the nodes only then. Hooks and remaining edges are
    written to the shared folder each round. ``edges`` has columns u and v; nulls and loops are ignored, as are
    repeated rows. Nodes without edges are their own root.
    """
    left = stored(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo").distinct(), "edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        hooks = flat(left.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        rounds.append(hooks)
        at = lambda df, c: salted_lookup(df, hooks.select(F.col("hi").alias(c), F.col("lo").alias("__to")), c, F.xxhash64("hi", "lo"), SALTS, merge=True).withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: B023, E731
        left = stored(at(at(left, "hi"), "lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct(), "edges")
    alone = nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct()
    if not rounds:
        return alone.withColumn("root", F.col("node"))
    forest = rounds[0] if len(rounds) == 1 else flat(reduce(DataFrame.unionByName, rounds), "forest")
    return salted_lookup(alone.withColumn("hi", F.col("node")), forest, "hi", F.xxhash64("node"), 1, merge=True).select("node", F.coalesce("lo", "node").alias("root"))


def nearest(reach: int, target: int) -> int:
    """The set bit nearest to ``target``, the lower of two equally near; bit 0 must be set."""
    low = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    high = target + (above & -above).bit_length() if above else None
    return low if high is None or target - low <= high - target else high


def take_sizes(sizes: dict[int, int], target: int, exact: int = 1 << 27) -> dict[int, int]:
    """How many groups of each size to take so that their sizes sum up as near to ``target`` as can be.

    Subset sums are bitsets in one integer each, a size's multiplicity being cut into powers of two. The way back
    needs the sums reached before each step: they are kept as long as they have at most ``exact`` bits together;
    longer ways are halved, and the sums of the second half formed again, so that few bitsets are held at a time.
    The result is the same. Of two sums equally near, the smaller is taken.
    """
    taken: Counter[int] = Counter()
    rest = {s: m for s, m in sizes.items() if s > 0 and m > 0}
    if target <= 0:
        return {}
    limit = target + max(rest, default=0)
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    add = lambda r, step: (r | r << (step[0] * step[1])) & mask
    for s in sorted(rest, reverse=True):
        m, k = rest[s], 1
        while m:
            k = min(k, m)
            if k * s <= limit:
                steps.append((s, k))
                reach = add(reach, (s, k))
            m -= k
            k *= 2
        if reach >> target & 1:
            break

    def back(part: list[tuple[int, int]], before: int, best: int) -> int:
        """Takes what of ``part`` leads from a sum in ``before`` to ``best``; returns that sum."""
        if len(part) > 1 and len(part) * limit > exact:
            half = len(part) // 2
            return back(part[:half], before, back(part[half:], reduce(add, part[:half], before), best))
        for (s, k), r in reversed(list(zip(part, accumulate(part, add, initial=before)))):
            if not r >> best & 1:
                taken[s] += k
                best -= s * k
        return best

    back(steps, 1, nearest(reach, target))
    return dict(taken)


def split_groups(groups: DataFrame, shares: dict[str, float], rest: str = "train") -> DataFrame:
    """(node, root, split) for the (node, root) rows of ``groups``: no group is divided.

    ``shares`` gives the part of every split except ``rest``. Only the table of group sizes and how often each
    occurs reaches the driver: its distinct sizes number less than the square root of twice the records. Which
    groups of a size are taken is decided by a hash of the root, so a rerun decides alike.
    """
    groups = stored(groups, "groups")
    sizes = stored(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    left = {int(r["size"]): int(r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(s * n for s, n in left.items())
    rows, start = [], Counter()
    for name, share in shares.items():
        for s, k in take_sizes(left, round(share * total)).items():
            rows.append((s, start[s], start[s] + k, name))
            start[s] += k
            left[s] -= k
    spark = groups.sparkSession
    plan = spark.createDataFrame(rows, "size long, after long, upto long, split string")
    ranked = spread_rank(sizes, ["size"], F.xxhash64("root"), "place", tie=["root"])
    ruled = ranked.join(plan, (ranked["size"] == plan["size"]) & (F.col("place") > F.col("after")) & (F.col("place") <= F.col("upto")), "left")
    named = ruled.select("root", F.coalesce("split", F.lit(rest)).alias("split"))
    return salted_lookup(groups, named, "root", F.xxhash64("node"), SALTS, merge=True)


def record_groups(spark, folder: str) -> DataFrame:
    """(node, root) of all plugins and patchmaps records: those of one plugin or maker share their root."""
    plugins = table(spark, folder, "plugins", "record_id", "slug", "author", "renamed_from")
    maps = table(spark, folder, "patchmaps", "record_id", "slug")
    slug = lambda df, c: df.select("record_id", F.concat(F.lit("s:"), slug_key(c)).alias("key"))
    keys = slug(plugins, "slug").unionByName(slug(plugins, "renamed_from")).unionByName(slug(maps, "slug"))
    keys = keys.unionByName(plugins.select("record_id", F.concat(F.lit("a:"), author_key("author")).alias("key")))
    nodes = plugins.select("record_id").unionByName(maps.select("record_id"))
    return components(nodes, stars(keys.distinct(), "record_id", "key"), "record_id")
