import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.operators import costs as A
from riskloom.operators import routing as R
from riskloom.operators import scoring as J
from riskloom.operators import timeseries as M
from riskloom.plans.cost_report import report_from_log
from riskloom.sources.call_log import append_calls, scan_calls
from riskloom.sources.scenarios import scan_scenarios

SCORES = "grounding_score double, clarity_score double, completeness_score double, audience_appropriateness_score double, uncertainty_handling_score double, uncertainty_flag boolean, failure_reasons array<string>"


@pytest.mark.parametrize("scores, flag, expected", [
    ((1.0, 0.96, 1.0, 0.97, None), False, 0.9840),
    ((1.0, 0.95, 0.75, 0.95, None), False, 0.9150),
    ((0.5, 0.2, 0.1, 0.1, None), False, 0.2450),
    ((1.0, 1.0, 1.0, 1.0, 1.0), True, 1.0),
    ((1.0, 1.0, 1.0, 1.0, 0.0), True, 0.8),
    ((1.0, 1.0, 1.0, 1.0, 0.0), False, 1.0),
    ((1.5, -1.0, 0.5, 0.5, None), False, 0.525),
])
def test_recorded_overall_scores(spark, scores, flag, expected):
    df = spark.createDataFrame([(*scores, flag, ["why"])], SCORES)
    r = J.score(df).first()
    assert r["overall_score"] == expected
    assert r["passed"] == (expected >= 0.70) and r["failure_reasons"] == ([] if r["passed"] else ["why"])


def test_scenarios(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([
        {"id": "GS-001", "transaction_id": "a", "expected_is_fraud": True},
        {"id": "GS-009", "transaction_id": "b", "expected_eval_passed": False, "inject_poor_explanation": "x"},
        {"id": "GS-010", "transaction_id": "c", "expected_eval_passed": False, "expected_overall_score_min": 0.75},
    ]))
    df = scan_scenarios(spark, str(path))
    assert df.count() == 3 and df.filter("expected_eval_passed IS NULL").count() == 1
    runs = df.join(spark.createDataFrame(
        [("a", True, None, True, None, None), ("b", False, None, True, False, 0.2), ("c", False, None, True, True, 0.72)],
        "transaction_id string, skipped boolean, error string, explanation_generated boolean, passed boolean, overall_score double"), "transaction_id")
    out = {r["id"]: (r["status"], r["mismatch"]) for r in J.scenario_status(runs).collect()}
    assert out == {"GS-001": ("SKIPPED", None), "GS-009": ("FAIL", None), "GS-010": ("PASS", "score below minimum")}
    assert tuple(J.scenario_summary(J.scenario_status(runs)).first()) == (1, 1, 1, 0, 1)


def calls(spark, rows):
    full = [(f"2024-01-01T00:0{i}:00", *r) for i, r in enumerate(rows)]
    schema = "timestamp string, transaction_id string, phase string, agent_name string, model string, input_tokens bigint, output_tokens bigint, duration_seconds double"
    return spark.createDataFrame(full, schema)


LOG = [("T1", "phase_3", "ExplanationAgent", "claude-haiku-4-5", 1000, 400, 1.0005), ("T1", "phase_4", "EvalAgent", "claude-sonnet-4-6", 1200, 300, 2.0),
       ("T2", None, "EvalAgent", "claude-sonnet-4-6", 20000, 2000, 3.0), ("T2", "phase_3", "ExplanationAgent", "gpt-4o", 100, 10, 1.0),
       ("T3", "phase_3", "ExplanationAgent", "who-knows", 100, 10, 1.0), ("T3", "phase_3", "ExplanationAgent", None, 100, 10, 1.0)]


def test_records(spark):
    rows = A.call_records(calls(spark, LOG)).orderBy("timestamp").collect()
    assert [r["tier"] for r in rows[:5]] == ["cheap", "strong", "strong", "cheap", "cheap"]
    assert rows[0]["cost_usd"] == round(1000 * 0.00000025 + 400 * 0.00000125, 8)
    assert rows[4]["cost_usd"] == rows[5]["cost_usd"] == round(100 * 1e-6 + 10 * 3e-6, 8)
    assert [r["budget_breached"] for r in rows] == [False, False, True, False, False, False]
    assert rows[0]["duration_seconds"] == round(1.0005, 3)
    assert A.call_records(calls(spark, [("T", "p", "a", "claude-sonnet-4-6", 0, 5333, 1.0), ("T", "p", "a", "m", 80000, 0, 1.0)])).filter("budget_breached").count() == 0


def test_report_from_log(spark, tmp_path):
    path = str(tmp_path / "log")
    records = A.call_records(calls(spark, LOG))
    append_calls(records, path)
    append_calls(records, path)
    (tmp_path / "log" / "extra.json").write_text("\n\n")
    assert scan_calls(spark, path).count() == 12
    assert scan_calls(spark, path, "phase_4").count() == 2
    line = next(p for p in (tmp_path / "log").glob("part*") if p.stat().st_size).read_text().split("\n")[0]
    assert set(json.loads(line)) == {"timestamp", "transaction_id", "phase", "agent_name", "model", "tier", "input_tokens", "output_tokens",
                                     "cost_usd", "duration_seconds", "confidence", "passed", "budget_breached"}
    report = {(r["section"], r["name"]): r for r in report_from_log(spark, path).collect()}
    assert report[("total", "all")]["calls"] == 12 and report[("total", "all")]["transactions"] == 3
    assert report[("phase", "unknown")]["calls"] == 2 and report[("tier", "strong")]["budget_breaches"] == 2
    assert {k for s, k in report if s == "agent"} == {"ExplanationAgent", "EvalAgent"}
    total = A.cost_totals(scan_calls(spark, path)).first()
    assert total["calls"] == 12 and total["transactions"] == 3 and total["budget_breaches"] == 2
    assert total["projected_per_100"] == pytest.approx(total["total_cost"] / 3 * 100, abs=1e-3)


def test_empty_log(spark):
    records = A.call_records(calls(spark, LOG)).limit(0)
    assert tuple(A.cost_totals(records).first()) == (0.0, 0, 0, 0.0, 0.0, 0)
    assert tuple(A.tier_mix(records).first())[0] == 0.0


def test_unknown_tier_counts_as_strong(spark):
    df = spark.createDataFrame([("cheap",), ("strong",), (None,), ("odd",)], "tier string")
    assert tuple(A.tier_mix(df).first()) == (25.0, 75.0)


def test_quantile_rules(spark):
    bounds = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([([2, 2, 4, 4],), ([0, 0, 0, 5],), ([0, 0, 0, 0],), ([0, 4, 4, 4],)], "counts array<bigint>")
    rows = df.select(*[M.quantile_from(F.col("counts"), bounds, q).alias(str(q)) for q in (0.25, 0.5, 0.75)]).collect()
    assert tuple(rows[0]) == (0.5, 1.0, 3.0)
    assert tuple(rows[1]) == (4.0, 4.0, 4.0)
    assert tuple(rows[2]) == (None, None, None)
    assert tuple(rows[3]) == (1.25, 1.5, 1.75)


def test_rate_limit_with_one_busy_client(spark):
    start = datetime(2024, 1, 1, 12, 0, 0)
    rows = [(i, start + timedelta(seconds=i % 120), "busy", 200) for i in range(400)] + [(1000 + i, start, f"c{i}", 200) for i in range(20)]
    limited = [(*r, "/api/v1/analyze") for r in rows]
    free = [(2000 + i, start, "free", 200, "/health") for i in range(30)] + [(3000 + i, start, "refused", 401, "/api/v1/analyze") for i in range(30)]
    other = [(4000 + i, start, "busy", 200, "/api/v1/analyze/stream") for i in range(11)]
    schema = "request_id int, ts timestamp, client string, status_code int, endpoint string"
    out = M.rate_limit(spark.createDataFrame(limited + free + other, schema)).collect()
    assert len(out) == 491
    assert not any(r["limited"] for r in out if r["client"] in ("free", "refused"))
    assert [r["request_id"] for r in out if r["limited"] and r["endpoint"].endswith("stream")] == [4010]
    out = [r for r in out if r["request_id"] < 2000]
    admitted = sorted((r["ts"], r["request_id"]) for r in out if not r["limited"] and r["client"] == "busy")
    expected = [x for minute in (0, 1) for x in sorted((r[1], r[0]) for r in rows if r[2] == "busy" and r[1].minute == minute)[:10]]
    assert admitted == expected
    assert all((r["status_code"] == 429) == r["limited"] for r in out)
    assert not any(r["limited"] for r in out if r["client"] != "busy")


def test_stage_order_and_json_nulls(spark):
    df = spark.createDataFrame(
        [("ok", None, None, None, None), ("inj", "bad", None, None, None), ("ev", None, None, None, "boom"), ("ex", None, None, "V9", None)],
        "transaction_id string, sanitize_error string, detect_error string, explain_error string, evaluate_error string")
    df = df.withColumns({n: F.struct(F.lit(1).alias("x"), F.lit(None).cast("string").alias("y")) for n in ("detection", "explanation", "evaluation")})
    events = {}
    for r in R.stage_events(R.route(df, streamed=True)).orderBy("transaction_id", "seq").collect():
        events.setdefault(r["transaction_id"], []).append(r["event"])
    assert events == {"ok": ["sanitize", "detection", "explanation", "evaluation", "complete"], "inj": ["error"],
                      "ev": ["sanitize", "detection", "explanation", "error", "complete"], "ex": ["sanitize", "detection", "error"]}
    out = {r["transaction_id"]: json.loads(r["result"]) for r in R.result_json(R.route(df)).collect()}
    assert out["inj"]["detection_result"] is None and out["inj"]["completed"] and out["ok"]["eval_result"] == {"x": 1, "y": None}


def test_timeout_boundaries(spark):
    rows = [("detect", 2.0, None, False), ("detect", 2.001, None, True), ("explain", 15.0, None, True), ("explain", 14.9, "x TIMEOUT", True),
            ("explain", 14.9, None, False), ("evaluate", 20.0, None, True), ("evaluate", 19.9, "err", False)]
    df = spark.createDataFrame(rows, "stage string, duration_seconds double, message string, expected boolean")
    assert R.classify_timeouts(df).filter("timed_out <> expected").count() == 0
