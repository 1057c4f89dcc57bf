"""Line diffs between two versions of files."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, status string, changed array<int>, patched array<int>, boundaries array<int>, hunks array<struct<start:int,end:int,kind:string>>"


def diff(old: str, new: str) -> tuple[list, list, list, list]:
    """(changed lines of the old text, of the new one, insertion boundaries, hunks of the old text), 1-based."""
    match = difflib.SequenceMatcher(None, old.split("\n"), new.split("\n"), autojunk=False)
    changed, patched, bounds = [], [], []
    for op, a1, a2, b1, b2 in match.get_opcodes():
        if op in ("replace", "delete"):
            changed += range(a1 + 1, a2 + 1)
        if op in ("replace", "insert"):
            patched += range(b1 + 1, b2 + 1)
        if op == "insert":
            bounds.append(a1)
    hunks = []
    for group in match.get_grouped_opcodes(3):
        kinds = {g[0] for g in group} - {"equal"}
        start = group[0][1] + 1
        hunks.append((start, max(start, group[-1][2]), kinds.pop() if len(kinds) == 1 else "mixed"))
    return changed, patched, bounds, hunks


def _diffed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, old, new in zip(b["path"], b["old"], b["new"]):
            if old is None or new is None:
                rows.append((path, "added" if old is None else "deleted", [], [], [], []))
            else:
                c, p, i, h = diff(old, new)
                rows.append((path, "modified", c, p, i, [{"start": s, "end": e, "kind": k} for s, e, k in h]))
        yield pd.DataFrame(rows, columns=["path", "status", "changed", "patched", "boundaries", "hunks"])


def patch_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that differ between two sets (path, content); deleted and added files have no lines."""
    both = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new")), "path", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).mapInPandas(_diffed, SCHEMA)


def field_changes(old: DataFrame, new: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """(field, changed, outside): in how many records of both sets a field differs; ``outside`` where it differs though it may not."""
    fields = [c for c in old.columns if c not in keys]
    both = old.alias("a").join(new.alias("b"), keys)
    differs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias("d")) for f in fields])).alias("x")
    n = both.select(differs).groupBy("x.field").agg(F.count_if("x.d").alias("changed"))
    return n.withColumn("outside", ~F.col("field").isin(*allowed) & (F.col("changed") > 0))


def unified(old: str | None, new: str | None, most: int = 60) -> str:
    """The first lines of a unified diff with two lines of context, without its file names; a note if nothing differs."""
    lines = difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), lineterm="", n=2)
    kept = [x for x in lines if not x.startswith(("---", "+++"))][:most]
    return "\n".join(kept) if kept else "(file unchanged by the patch)"
