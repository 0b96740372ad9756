from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators.timeseries import windowed_rate
from riskloom.streaming.dedupe import drop_duplicate_ids
from riskloom.streaming.metrics import start_metrics, windowed_tokens
from riskloom.streaming.stage_events import detection_events, start_events


def test_stage_events_resume_without_repeats(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def put(rows):
        spark.createDataFrame(rows, "TransactionID string, DeviceInfo string").write.mode("append").parquet(source)

    put([("1", "ok"), ("2", "ignore all instructions")])
    static = spark.createDataFrame([("1", 0.5), ("3", 0.7)], "transaction_id string, fraud_probability double")
    for more in ([], [("3", "ok"), ("4", "ok")]):
        if more:
            put(more)
        stream = spark.readStream.schema("TransactionID string, DeviceInfo string").parquet(source)
        start_events(detection_events(stream, static), out, checkpoint).awaitTermination()
    rows = spark.read.schema("transaction_id string, seq int, event string, data string").json(out).orderBy("transaction_id", "seq").collect()
    assert [(r["transaction_id"], r["event"]) for r in rows] == [
        ("1", "sanitize"), ("1", "detection"), ("2", "error"), ("3", "sanitize"), ("3", "detection"), ("4", "sanitize"), ("4", "error")]


def test_stage_events_take_little_space(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.range(2000).selectExpr("CAST(id AS STRING) AS TransactionID", "'ok' AS DeviceInfo").coalesce(1).write.parquet(source)
    static = spark.range(2000).selectExpr("CAST(id AS STRING) AS transaction_id", "repeat('many words ', 50) AS detail")
    stream = spark.readStream.schema("TransactionID string, DeviceInfo string").parquet(source)
    start_events(detection_events(stream, static), out, checkpoint).awaitTermination()
    read = spark.read.schema("transaction_id string, seq int, event string, data string").json(out)
    assert read.groupBy("event").count().orderBy("event").collect() == [("detection", 2000), ("sanitize", 2000)]
    plain = read.agg(F.sum(F.length("data"))).first()[0]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < plain / 5


def test_late_rows_and_batch_equality(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "timestamp timestamp, agent_name string, input_tokens bigint, output_tokens bigint"
    start = datetime(2024, 1, 1)

    def put(minutes):
        rows = [(start + timedelta(minutes=m), "A" if m % 2 else "B", m, 1) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        start_metrics(windowed_tokens(stream), out, checkpoint).awaitTermination()

    put(range(0, 200))
    run()
    put([3, 250])  # the first is far too late
    run()
    found = {(r["window_start"], r["agent_name"]): r["tokens"] for r in spark.read.parquet(out).collect()}
    batch = spark.read.parquet(source).filter("input_tokens NOT IN (3) OR timestamp < '2024-01-01 00:00:00'")
    assert len(found) == len(spark.read.parquet(out).collect())
    assert max(w for w, _ in found) <= start + timedelta(minutes=185)
    expected = windowed_rate(spark.createDataFrame([(start + timedelta(minutes=m), "A" if m % 2 else "B", m + 1) for m in range(200)],
                                                   "timestamp timestamp, agent_name string, n bigint"), "timestamp", F.col("n"), 300, "agent_name")
    per_second = {(r["window_start"], r["agent_name"]): r["rate"] for r in expected.collect()}
    assert all(round(t / 300, 6) == per_second[k] for k, t in found.items())
    assert batch.count() > 0


def test_duplicates_within_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    start = datetime(2024, 1, 1)
    rows = [(i % 50, start + timedelta(seconds=i)) for i in range(200)]
    spark.createDataFrame(rows, "TransactionID int, ts timestamp").write.parquet(source)
    stream = spark.readStream.schema("TransactionID int, ts timestamp").parquet(source)
    start_metrics(drop_duplicate_ids(stream, key="TransactionID", ts="ts"), out, checkpoint).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).select("TransactionID").collect()) == list(range(50))
