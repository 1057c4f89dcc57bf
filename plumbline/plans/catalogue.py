"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import analyses, frames, reports, scans, studies

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "scan_sources"
QUERIES: dict[str, Query] = frames.QUERIES | analyses.QUERIES | studies.QUERIES | scans.QUERIES
SQL: dict[str, str] = {name: reports.duck(name) for name in reports.REPORTS} | analyses.SQL | studies.SQL | scans.SQL
