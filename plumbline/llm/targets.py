"""Sample matching target category proportions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pivotal import dealt, round_groups
from plumbline.llm.topn import classed
from plumbline.session import stored
from plumbline.sources.tables import table

def tilt(have: np.ndarray, want: np.ndarray, steps: int = 50, near: float = 1e-10) -> np.ndarray:
    """Weights exp(lambda) that make the category moments ``have`` equal ``want``, by Newton steps on the dual.

    The dual of the exponential tilting is sum have exp(lambda) - want lambda; with disjoint categories its
    Hessian is diagonal, so that all categories step at once. Categories that have or want nothing get 0.
    """
    open_ = (have > 0) & (want > 0)
    lam = np.zeros(len(have))
    for _ in range(steps):
        now = np.where(open_, have * np.exp(lam), 0.0)
        gap = np.where(open_, now - want, 0.0)
        if np.abs(gap).max(initial=0) <= near * max(1.0, want.max(initial=0)):
            break
        lam -= np.clip(np.divide(gap, now, out=np.zeros_like(gap), where=open_), -2, 2)
    return np.where(open_, np.exp(lam), 0.0)


def goals(target: np.ndarray, floor: np.ndarray, total: float) -> np.ndarray:
    """What a sample of ``total`` should hold of each category: its target, or its floor where that is greater.

    Floors are an active set: categories whose part of what is left falls below their floor are fixed there, the
    others divide the rest in proportion to their targets, until no further one falls below. If the floors alone
    reach the total, the others get nothing.
    """
    fixed = np.zeros(len(target), bool)
    while True:
        free = ~fixed
        rest, asked = max(total - floor[fixed].sum(), 0.0), target[free].sum()
        goal = np.where(fixed, floor, target * (rest / asked if asked > 0 else 0.0))
        low = free & (goal < floor)
        if not low.any():
            return goal
        fixed |= low


def calibrate(moments: DataFrame, keys: str = "plan_id long") -> DataFrame:
    """The report of each plan: what every category should and can give.

    ``moments``: rows (plan, category ``vuln_class``, ``available``, ``target`` = share x total, ``floor``).
    The dual is solved twice. First for what is asked, ``wanted`` = the greater of target and floor: a category
    that would need a weight above 1 (or has nothing) cannot give it, which is ``unmet`` after an exact check of
    the numbers. Then for what is drawn: the ``goal`` of each category (see ``goals``; the total is the sum of the
    plan's targets, rounded), of which a category gives all it has at most; the other categories don't make up
    for it, so their shares of the total stay. Its weights are the ``probability`` of a unit, ``drawn`` is the
    expected number. Plans are independent groups of a few categories each. Null availability counts as none,
    a null target or floor as 0.
    """
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        have, target, floor = (rows[c].fillna(0).to_numpy(float) for c in ("available", "target", "floor"))
        wanted = np.maximum(target, floor)
        needed = np.where(have > 0, tilt(have, wanted), np.where(wanted > 0, np.inf, 0.0))
        unmet = (needed > 1 - 1e-6) & (have < wanted)
        goal = goals(target, floor, float(round(target.sum())))
        p = np.minimum(tilt(have, np.minimum(goal, have)), 1.0)
        return rows.assign(available=have.astype("int64"), wanted=wanted, goal=goal, probability=p, drawn=p * have, unmet=unmet)

    name = keys.split()[0]
    schema = f"{keys}, vuln_class string, available long, target double, floor double, wanted double, goal double, probability double, drawn double, unmet boolean"
    return moments.groupBy(name).applyInPandas(one, schema)


def units(spark, folder: str) -> DataFrame:
    """One row for each finding with a class: finding_id, tool, cls and whether the study lists its record."""
    rows = table(spark, folder, "findings", "finding_id", "slug", "cve", "tool", "vuln_class")
    rows = classed(rows, table(spark, folder, "class_aliases"))
    rows = rows.select("finding_id", "tool", "cls", F.concat("slug", F.lit("|"), F.coalesce("cve", F.lit("-"))).alias("record_key"))
    once = rows.where("finding_id IS NOT NULL").groupBy("finding_id").agg(F.min(F.struct("cls", "tool", "record_key")).alias("x")).select("finding_id", "x.*")
    listed = table(spark, folder, "study_sample", "record_key").where("record_key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    return once.join(listed, "record_key", "left").select("finding_id", "tool", "cls", F.coalesce("listed", F.lit(False)).alias("study"))


def cells(found: DataFrame) -> DataFrame:
    """Category moments of the findings: counts by tool, study membership and class, summed in each task first."""
    return found.groupBy("tool", "study", "cls").agg(F.count(F.lit(1)).alias("n"))


def reach(plans: DataFrame, counts: DataFrame) -> DataFrame:
    """Plan rows with each cell of findings that they may draw from (a plan without a tool draws from all)."""
    on = (plans["vuln_class"] == counts["cls"]) & ((plans["frame"] == "all") | counts["study"])
    named = plans.where("tool IS NOT NULL").alias("p").join(counts.withColumnRenamed("tool", "cell_tool"), (F.col("tool") == F.col("cell_tool")) & (F.col("p.vuln_class") == F.col("cls")) & ((F.col("frame") == "all") | F.col("study")))
    free = plans.where("tool IS NULL").join(counts.withColumnRenamed("tool", "cell_tool"), on)
    return named.unionByName(free)


def plans_of(spark, folder: str) -> DataFrame:
    return table(spark, folder, "sample_targets").where("plan_id IS NOT NULL AND vuln_class IS NOT NULL")


def report(plans: DataFrame, counts: DataFrame) -> DataFrame:
    """``calibrate`` for the plans over the counts; one row for each plan and class."""
    have = reach(plans, counts).groupBy("plan_id", "vuln_class").agg(F.sum("n").alias("available"))
    moments = plans.join(have, ["plan_id", "vuln_class"], "left").select(
        "plan_id", "vuln_class", F.coalesce("available", F.lit(0)).cast("long").alias("available"),
        (F.col("target_share") * F.col("plan_total")).alias("target"), F.col("min_rows").cast("double").alias("floor"))
    return calibrate(moments)


def drawn(spark, folder: str, seed: int = 7) -> DataFrame:
    """(plan_id, vuln_class, finding_id): the sample of every plan.

    Every unit that a plan may draw has its calibrated probability, and the pivotal method rounds the units: in
    slices by a hash, then over a tree, inside the plan's class first and at last inside the plan. So a class
    gives its goal to one unit, the plan its total to one. Units are shuffled once, into their slices; there they
    meet the plans, whose table is small (the optimiser checks its size), and only units taken or still open
    leave the slice.
    """
    found = stored(units(spark, folder), "units")
    plans = plans_of(spark, folder)
    told = report(plans, cells(found)).where("probability > 0").select("plan_id", "vuln_class", "probability")
    asked = stored(plans.select("plan_id", "vuln_class", "frame", F.col("tool").alias("asked_tool")).join(told, ["plan_id", "vuln_class"]).distinct(), "plans")
    may = (F.col("cls") == F.col("vuln_class")) & (F.col("asked_tool").isNull() | (F.col("asked_tool") == F.col("tool"))) & ((F.col("frame") == "all") | F.col("study"))
    parts = dealt(found, ["finding_id"], seed).join(asked, may).select("plan_id", "vuln_class", "finding_id", "probability", "__slice")
    rounded = round_groups(parts, ["plan_id", "vuln_class"], "probability", ["finding_id"], seed, outer=["plan_id"], losers=False)
    return rounded.where("up = 1").select("plan_id", "vuln_class", "finding_id")
