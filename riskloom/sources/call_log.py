"""The append-only log of model calls, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom import schemas
from riskloom.operators.costs import in_phase

_FIELDS = schemas.CALL_RECORD.fieldNames()


def _as_text_time(records: DataFrame) -> DataFrame:
    """Time stamps as ISO-8601 text in UTC, as the log holds them."""
    if dict(records.dtypes)["timestamp"] == "string":
        return records.select(*_FIELDS)
    iso = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return records.withColumn("timestamp", iso).select(*_FIELDS)


def append_calls(records: DataFrame, path: str) -> None:
    """Append records; null fields are written out, as every line has all 13 fields."""
    _as_text_time(records).write.mode("append").option("ignoreNullFields", "false").json(path)


def append_calls_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream, each record exactly once."""
    return (
        _as_text_time(records).writeStream.format("json").option("ignoreNullFields", "false")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def scan_calls(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """Read the log with its explicit schema; blank lines are skipped by the reader."""
    return in_phase(spark.read.schema(schemas.CALL_RECORD).json(path), phase)


def with_event_time(records: DataFrame) -> DataFrame:
    return records.withColumn("timestamp", F.to_timestamp("timestamp"))
