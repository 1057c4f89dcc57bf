"""Fixpoints over edges: closures, nearest ancestors, reachability with the best label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, stored


def closure(edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, dict]:
    """(node, ancestor, depth) for all ancestors of (child, parent) edges, and how the fixpoint ended.

    Semi-naive: a round joins only what the last one found. Cycles end because a pair is kept at its first depth, so
    the fixpoint is always reached; ``rounds`` may end it earlier, which the second value tells.
    """
    base = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL AND node <> ancestor").distinct()
    known = stored(base.withColumn("depth", F.lit(1)), "closure")
    delta, n = known, 1
    while rounds is None or n < rounds:
        step = delta.alias("d").join(base.alias("b"), F.col("d.ancestor") == F.col("b.node")).select(F.col("d.node").alias("node"), F.col("b.ancestor").alias("ancestor")).where("node <> ancestor").distinct()
        delta = stored(step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(n + 1)), "closure")
        if delta.isEmpty():
            return known, {"converged": True, "rounds": n}
        known, n = known.unionByName(delta), n + 1
    return known, {"converged": False, "rounds": n}


def nearest(closed: DataFrame, definitions: DataFrame) -> DataFrame:
    """(node, key, owner): for each node and defined key, the definition on itself or on its nearest ancestor."""
    own = definitions.select(F.col("owner").alias("node"), "key", "owner", F.lit(0).alias("depth"))
    above = closed.join(definitions, F.col("ancestor") == F.col("owner")).select("node", "key", "owner", "depth")
    return own.unionByName(above).groupBy("node", "key").agg(F.min(F.struct("depth", "owner")).alias("x")).select("node", "key", "x.owner")


def reach(calls: DataFrame, starts: DataFrame, hops: int = 6) -> DataFrame:
    """(node, priority): the least priority of any start that reaches the node in at most ``hops`` calls.

    ``calls``: (caller, callee), ``starts``: (node, priority). A round joins the nodes whose priority fell.
    """
    edges = calls.select("caller", "callee").distinct()
    best = cut(starts.groupBy("node").agg(F.min("priority").alias("priority")))
    delta = best
    for _ in range(hops):
        step = delta.join(edges, F.col("node") == F.col("caller")).groupBy("callee").agg(F.min("priority").alias("p"))
        better = cut(step.join(best, F.col("callee") == F.col("node"), "left").where("priority IS NULL OR p < priority").select(F.col("callee").alias("node"), F.col("p").alias("priority")))
        if better.isEmpty():
            break
        best = cut(best.unionByName(better).groupBy("node").agg(F.min("priority").alias("priority")))
        delta = better
    return best
