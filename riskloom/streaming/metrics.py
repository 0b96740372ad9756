"""Counters and rates kept up to date over an unbounded call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEFAULT_LATENESS = "1 hour"


def windowed_tokens(calls: DataFrame, *, seconds: int = 300, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Tokens, calls and token rate by agent and window.

    The state is one row per open window and agent; the watermark closes windows and drops
    rows that come later. Rows combine within each task before the shuffle.
    """
    w = F.window("timestamp", f"{seconds} seconds").alias("w")
    both = F.col("input_tokens") + F.col("output_tokens")
    return (
        calls.withWatermark("timestamp", lateness)
        .groupBy(w, "agent_name")
        .agg(F.sum(both).alias("tokens"), F.count("*").alias("calls"))
        .select(
            F.col("w.start").alias("window_start"), "agent_name", "tokens", "calls",
            (F.col("tokens") / F.lit(float(seconds))).alias("rate"),
        )
    )


def windowed_counters(calls: DataFrame, *, seconds: int = 300, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Tokens by agent, model and direction in each window; state and lateness as above."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("token_type"), F.col(f"{side}_tokens").cast("long").alias("n")) for side in ("input", "output")
    ])
    return (
        calls.withWatermark("timestamp", lateness).withColumn("side", F.explode(sides))
        .groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), "agent_name", "model", F.col("side.token_type").alias("token_type"))
        .agg(F.sum("side.n").alias("tokens"))
        .select(F.col("w.start").alias("window_start"), "agent_name", "model", "token_type", "tokens")
    )


def windowed_requests(requests: DataFrame, *, seconds: int = 300, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Requests and their rate by endpoint and status in each window."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "endpoint", "status_code").agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "endpoint", "status_code", "requests",
            (F.col("requests") / F.lit(float(seconds))).alias("rate"),
        )
    )


def start_metrics(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet until the input is used up."""
    return (
        windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
