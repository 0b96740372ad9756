"""Stage events over an unbounded input of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom import fixed_values as fixed
from riskloom import schemas
from riskloom.operators.routing import injection_error, route, stage_events
from riskloom.operators.safety import scan_fields
from riskloom.plans.run_pipeline import run_pipeline


def detection_events(transactions: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """Events as far as a stream can go without the remote calls: screening and detection.

    ``detections`` is a static table of records joined on the id; without it the row itself
    carries a ``detection`` struct. Stateless, so results leave with their micro-batch.
    """
    row_id = F.col(fixed.ROW_ID).cast("string")
    rows = scan_fields(transactions).withColumns(
        {"transaction_id": row_id, "sanitize_error": injection_error(F.col("injection"))}
    )
    if detections is not None:
        packed = detections.select("transaction_id", F.struct(*detections.columns).alias("detection"))
        rows = rows.join(packed, "transaction_id", "left")
    rows = rows.select(
        "transaction_id", "detection", "sanitize_error",
        F.when(F.col("detection").isNull(), "no detection").alias("detect_error"),
    )
    later = {n: F.lit(None).cast("string") for n in ("explain_error", "evaluate_error")}
    later |= {
        "explanation": F.lit(None).cast(schemas.EXPLANATION), "evaluation": F.lit(None).cast(schemas.EVALUATION)
    }
    # Neither explained nor judged in this job: those events do not arise.
    return stage_events(route(rows.withColumns(later), streamed=True)).filter(
        F.col("event").isin("sanitize", "detection", "error")
    )


def pipeline_events(
    transactions: DataFrame, detections: DataFrame, responses: DataFrame, judged: DataFrame, *, audience: str = "analyst"
) -> DataFrame:
    """All six events over a stream of transactions; what the remote calls gave is recorded in
    tables joined on the id. Stateless: each transaction's events leave with its micro-batch."""
    return stage_events(run_pipeline(transactions, detections, responses, judged, audience=audience, streamed=True))


def start_events(events: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append events to JSON files, each exactly once; ``once`` stops when the input is used up.

    The files are compressed: the last event repeats the whole record, so plain text takes many
    times the space of the input."""
    writer = (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", "false").option("compression", "gzip").outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
