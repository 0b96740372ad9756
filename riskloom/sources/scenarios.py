"""Scenario files: one JSON array whose objects carry different keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom import schemas


def scan_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Read with the superset of keys; absent keys are null."""
    return spark.read.schema(schemas.SCENARIO).json(path, multiLine=True)
