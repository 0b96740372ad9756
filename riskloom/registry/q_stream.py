"""Queries that run as streams over the event table until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.functions.numbers import round_even
from riskloom.operators.costs import call_records
from riskloom.registry import bindings as b
from riskloom.registry.core import query
from riskloom.registry.oracle_bindings import rounded
from riskloom.registry.q_costs import _STAGED, _staged_inputs
from riskloom.session import settle, shared_folder
from riskloom.sources.call_log import append_calls_stream, scan_calls
from riskloom.streaming.dedupe import drop_duplicate_ids
from riskloom.streaming.metrics import start_metrics, windowed_counters, windowed_requests, windowed_tokens
from riskloom.streaming.stage_events import detection_events, pipeline_events, start_events


class _EventStream:
    """Stands in for a session whose ``events`` table is read as a stream."""

    def __init__(self, spark):
        self._spark = spark
        self.read = self

    def parquet(self, path: str):
        schema = self._spark.read.parquet(path).schema
        stream = self._spark.readStream.schema(schema).parquet(f"{path}*")
        # Event time has to carry a zone for watermarks.
        return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _places(spark, what: str) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _drained(stream_query) -> None:
    stream_query.awaitTermination()


@query("stage_events_stream", oracle="""
SELECT CAST(event_id AS VARCHAR) AS transaction_id, 5 AS seq, 'error' AS event, 'sanitize' AS detail FROM events WHERE event_id % 97 = 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 1, 'sanitize', 'ok' FROM events WHERE event_id % 97 <> 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 2, 'detection', event_type FROM events WHERE event_id % 97 <> 0 AND event_type <> 'error'
UNION ALL SELECT CAST(event_id AS VARCHAR), 5, 'error', 'detect' FROM events WHERE event_id % 97 <> 0 AND event_type = 'error'""")
def _(spark, d):
    """Events of type error stand for transactions that were not detected."""
    source = _EventStream(spark)
    kind = F.col("event_type")
    info = F.when(F.col("event_id") % 97 == 0, b.INJECTED).otherwise("Windows 10").alias("DeviceInfo")
    rows = b.table(source, d, "events").select(
        F.col("event_id").alias("TransactionID"), info, F.when(kind != "error", F.struct(kind.alias("kind"))).alias("detection")
    )
    out, checkpoint = _places(spark, "stage-events")
    _drained(start_events(detection_events(rows), out, checkpoint))
    read = spark.read.schema("transaction_id string, seq int, event string, data string").json(out)
    detail = F.coalesce(*[F.get_json_object("data", f"$.{k}") for k in ("error_stage", "status", "kind")])
    return read.select("transaction_id", "seq", "event", detail.alias("detail"))


@query("pipeline_events_stream", "cleaned", "f_det", "ranked_attr", "f_resp", "scored", oracle=f"""WITH {_STAGED}
SELECT transaction_id, CAST(e.seq AS INT) AS seq, e.event AS event, CASE e.event WHEN 'error' THEN error_stage WHEN 'sanitize' THEN 'ok' END AS detail
FROM (SELECT *, unnest(list_filter([
    CASE WHEN error_stage IS DISTINCT FROM 'sanitize' THEN {{'seq': 1, 'event': 'sanitize'}} END,
    CASE WHEN error_stage IS DISTINCT FROM 'sanitize' THEN {{'seq': 2, 'event': 'detection'}} END,
    CASE WHEN error_stage IS NULL OR error_stage = 'evaluate' THEN {{'seq': 3, 'event': 'explanation'}} END,
    CASE WHEN error_stage IS NULL AND outcome = 'ok' THEN {{'seq': 4, 'event': 'evaluation'}} END,
    CASE WHEN error_stage IS NOT NULL THEN {{'seq': 5, 'event': 'error'}} END,
    CASE WHEN error_stage IS NULL OR error_stage = 'evaluate' THEN {{'seq': 6, 'event': 'complete'}} END],
    lambda x: x IS NOT NULL)) AS e FROM judged)""")
def _(spark, d):
    """The cleaned transactions come in as files; responses and scores are recorded tables."""
    transactions, detections, responses, judged = _staged_inputs(spark, d)
    arrived = settle(transactions)
    stream = spark.readStream.schema(arrived.schema).parquet(arrived.inputFiles()[0].rpartition("/")[0])
    out, checkpoint = _places(spark, "pipeline-events")
    _drained(start_events(pipeline_events(stream, settle(detections), settle(responses), settle(judged)), out, checkpoint))
    read = spark.read.schema("transaction_id string, seq int, event string, data string").json(out)
    detail = F.coalesce(*[F.get_json_object("data", f"$.{k}") for k in ("error_stage", "status")])
    return read.select("transaction_id", "seq", "event", detail.alias("detail"))


_CLOSED = "{t} + INTERVAL 1 HOUR <= (SELECT max({c}) - INTERVAL 1 HOUR FROM {f})"


@query("counters_stream", "f_calls", oracle=f"""
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, agent_name, model, token_type, CAST(sum(n) AS BIGINT) AS tokens
FROM (SELECT timestamp, agent_name, model, 'input' AS token_type, input_tokens AS n FROM f_calls
  UNION ALL SELECT timestamp, agent_name, model, 'output', output_tokens FROM f_calls)
WHERE {_CLOSED.format(t="time_bucket(INTERVAL 1 HOUR, timestamp)", c="timestamp", f="f_calls")} GROUP BY ALL""")
def _(spark, d):
    windows = windowed_counters(b.f_calls(_EventStream(spark), d), seconds=3600)
    out, checkpoint = _places(spark, "counters")
    _drained(start_metrics(windows, out, checkpoint))
    return spark.read.schema(windows.schema).parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("requests_stream", "f_req", oracle=f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, endpoint, status_code, count(*) AS requests, {rounded('count(*) / 3600e0', 6)} AS rate
FROM f_req WHERE {_CLOSED.format(t="time_bucket(INTERVAL 1 HOUR, ts)", c="ts", f="f_req")} GROUP BY ALL""")
def _(spark, d):
    windows = windowed_requests(b.f_req(_EventStream(spark), d), seconds=3600)
    out, checkpoint = _places(spark, "requests")
    _drained(start_metrics(windows, out, checkpoint))
    read = spark.read.schema(windows.schema).parquet(out)
    return read.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "rate": round_even(F.col("rate"), 6)})


@query("metrics_stream", "f_calls", oracle=f"""
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, agent_name, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
  count(*) AS calls, {rounded('sum(input_tokens + output_tokens) / 3600e0', 6)} AS rate
FROM f_calls WHERE time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM f_calls)
GROUP BY ALL""")
def _(spark, d):
    """Windows that the watermark, one hour behind the newest call, has closed."""
    windows = windowed_tokens(b.f_calls(_EventStream(spark), d), seconds=3600)
    out, checkpoint = _places(spark, "metrics")
    _drained(start_metrics(windows, out, checkpoint))
    read = spark.read.schema(windows.schema).parquet(out)
    return read.withColumns(
        {"window_start": F.col("window_start").cast("timestamp_ntz"), "rate": round_even(F.col("rate"), 6)}
    )


@query("duplicate_ids_stream", oracle="SELECT event_id, event_type FROM events")
def _(spark, d):
    """Every event comes in twice; one of each stays."""
    events = b.table(_EventStream(spark), d, "events").select("event_id", "event_type", "ts")
    once = drop_duplicate_ids(events.unionByName(events), key="event_id", ts="ts")
    out, checkpoint = _places(spark, "unique")
    _drained(start_metrics(once, out, checkpoint))
    return spark.read.schema(once.schema).parquet(out).select("event_id", "event_type")


@query("append_call_log", "records", oracle="""
SELECT transaction_id, phase, agent_name, model, tier, input_tokens, output_tokens, cost_usd, duration_seconds, budget_breached FROM records""")
def _(spark, d):
    out, checkpoint = _places(spark, "call-log")
    _drained(append_calls_stream(call_records(b.f_calls(_EventStream(spark), d)), out, checkpoint))
    return scan_calls(spark, out).drop("timestamp", "confidence", "passed")
