"""The analysis over tables of source files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.engine.flow import Plugin
from plumbline.operators.findings import exploitability

FINDING = "file string, line int, vuln_class string, message string, source string, sink string, trace array<string>, interprocedural boolean, confidence double, entry_point string, guard_deficit double, function string, sink_file string, sink_line int, seq int"
STATUS = "converged boolean, updates int, rounds int, capped int, errors int, findings int, failed string"
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]


def _analysed(pdf: pd.DataFrame, cap: int, guards: bool, **options: bool) -> tuple[list[dict], dict]:
    files = sorted({p: t for p, t in sorted(zip(pdf["path"], pdf["content"]), key=str) if t is not None and p is not None}.items())  # a path counts once
    try:
        plugin = Plugin(files, cap, guards, **options)
        return plugin.findings, {**plugin.status, "findings": len(plugin.findings), "failed": None}
    except Exception as e:  # one plugin must never end the job; its status says what happened
        return [], {"converged": False, "updates": 0, "rounds": 0, "capped": 0, "errors": 0, "findings": 0, "failed": type(e).__name__}


def _spread(files: DataFrame, key: str) -> DataFrame:
    """Releases over a fixed number of tasks: the work of a release isn't told by its bytes, so small partitions must not be joined."""
    spark = files.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select(key, "path", "content").repartition(n, key).groupBy(key)


def scan(files: DataFrame, key: str = "record_id", cap: int = 32, guards: bool = True, **options: bool) -> DataFrame:
    """Findings of each release, from rows (key, path, content).

    A release is analysed in one piece, as its calls and properties cross files; its size is that of one plugin's
    archive, however many releases there are. Null contents and paths are passed over, other columns ignored.
    ``options`` are those of ``flow.Plugin``.
    """
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = _analysed(pdf, cap, guards, **options)
        out = pd.DataFrame(found, columns=COLUMNS)
        out.insert(0, key, keys[0])
        return out.astype({"line": "int32", "sink_line": "int32", "seq": "int32"})

    return _spread(files, key).applyInPandas(run, f"{key} {dict(files.dtypes)[key]}, {FINDING}")


def status(files: DataFrame, key: str = "record_id", cap: int = 32, guards: bool = True) -> DataFrame:
    """How the analysis of each release ended: fixpoint reached, rounds, keys over the cap, statements not read."""
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, told = _analysed(pdf, cap, guards)
        return pd.DataFrame([{key: keys[0], **told}])

    return _spread(files, key).applyInPandas(run, f"{key} {dict(files.dtypes)[key]}, {STATUS}")


def ranked(found: DataFrame, key: str = "record_id", flow: float = 1.0, guard: float = 0.5, center: float = 0.0) -> DataFrame:
    """Findings with ``score`` and ``rank``: exploitability descending, then the order of discovery."""
    from pyspark.sql import Window

    scored = found.withColumns({"ep": F.col("entry_point"), "inter": F.col("interprocedural"), "conf": F.col("confidence"), "deficit": F.col("guard_deficit")})
    scored = scored.withColumn("score", F.round(exploitability(flow, guard, center), 9)).drop("ep", "inter", "conf", "deficit")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "seq")))
