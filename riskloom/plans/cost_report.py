"""The cost report from a log on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.costs import cost_report
from riskloom.sources.call_log import scan_calls


def report_from_log(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    return cost_report(scan_calls(spark, path, phase))
