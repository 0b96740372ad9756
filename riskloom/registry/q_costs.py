"""Queries: scoring, routing, cost accounting, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.numbers import round_even
from riskloom.operators import costs as A
from riskloom.operators import routing as R
from riskloom.operators import scoring as J
from riskloom.operators import timeseries as M
from riskloom.operators.checks import check_explanation
from riskloom.operators.join import price_calls, scenarios_with_detections
from riskloom import fixed_values as fixed
from riskloom.plans.load_clean import clean_tables
from riskloom.plans.run_pipeline import calls_of_run, run_pipeline
from riskloom.registry import bindings as b
from riskloom.registry.core import query
from riskloom.registry.oracle_bindings import rounded

# --- scoring --------------------------------------------------------------------------


@query("clamp_scores", "f_scores", oracle="""
SELECT transaction_id, greatest(0e0, least(1e0, grounding_score)) AS grounding_score,
  greatest(0e0, least(1e0, clarity_score)) AS clarity_score,
  CASE WHEN uncertainty_handling_score IS NOT NULL THEN greatest(0e0, least(1e0, uncertainty_handling_score)) END AS uncertainty_handling_score
FROM f_scores""")
def _(spark, d):
    return J.clamp_scores(b.f_scores(spark, d)).select(
        "transaction_id", "grounding_score", "clarity_score", "uncertainty_handling_score"
    )


@query("overall_score", "scored", oracle=f"SELECT transaction_id, {rounded('raw_overall', 4)} AS overall_score FROM scored")
def _(spark, d):
    return J.score(b.f_scores(spark, d)).select("transaction_id", "overall_score")


@query("uncertainty_gate", "f_scores", oracle="""
SELECT transaction_id, CASE WHEN uncertainty_flag THEN uncertainty_handling_score END AS uncertainty_handling_score FROM f_scores""")
def _(spark, d):
    return J.uncertainty_gate(b.f_scores(spark, d)).select("transaction_id", "uncertainty_handling_score")


@query("pass_fail", "scored", oracle="""
SELECT transaction_id, raw_overall >= 0.70e0 AS passed,
  CASE WHEN raw_overall >= 0.70e0 THEN '' ELSE array_to_string(failure_reasons, ',') END AS reasons FROM scored""")
def _(spark, d):
    return J.score(b.f_scores(spark, d)).select(
        "transaction_id", "passed", F.array_join("failure_reasons", ",").alias("reasons")
    )


@query("skip_ungenerated", "f_expl", "scored", oracle=f"""
SELECT e.transaction_id, CASE WHEN e.explanation_generated THEN {rounded('raw_overall', 4)} END AS overall_score, true AS completed
FROM f_expl e JOIN scored USING (transaction_id)""")
def _(spark, d):
    explanations = b.f_expl(spark, d).select("transaction_id", "explanation_generated")
    judged = J.generated_only(explanations).join(b.f_scores(spark, d), "transaction_id").transform(J.score)
    return explanations.join(judged.select("transaction_id", "overall_score"), "transaction_id", "left").select(
        "transaction_id", "overall_score", F.lit(True).alias("completed")
    )


def _scenario_runs(spark, d):
    with_d = scenarios_with_detections(b.f_scenarios(spark, d), b.f_det(spark, d).filter("fraud_probability <= 1"))
    generated = b.f_expl(spark, d).select("transaction_id", "explanation_generated")
    judged = J.score(b.f_scores(spark, d)).select("transaction_id", "passed", "overall_score", F.col("message").alias("error"))
    rows = with_d.select("transaction_id", "id", "skipped", "expected_eval_passed", "expected_overall_score_min")
    return J.scenario_status(rows.join(generated, "transaction_id").join(judged, "transaction_id"))


_RUNS = f"""
runs AS (SELECT s.*, e.explanation_generated, v.message AS error, v.raw_overall >= 0.70e0 AS passed, {rounded('v.raw_overall', 4)} AS overall_score,
    s.id IN ('GS-004','GS-005','GS-008') OR d.transaction_id IS NULL AS skipped
  FROM f_scenarios s LEFT JOIN (SELECT * FROM f_det WHERE fraud_probability <= 1) d USING (transaction_id)
  JOIN f_expl e USING (transaction_id) JOIN scored v USING (transaction_id)),
stated AS (SELECT *, CASE WHEN skipped THEN 'SKIPPED' WHEN error IS NOT NULL THEN 'ERROR' WHEN NOT explanation_generated THEN 'DEGRADED'
    WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM runs),
marked AS (SELECT *, CASE WHEN status IN ('PASS','FAIL') AND overall_score < expected_overall_score_min THEN 'score below minimum'
    WHEN status IN ('PASS','FAIL') AND passed <> expected_eval_passed THEN 'passed differs' END AS mismatch FROM stated)"""


@query("scenario_status", "f_scenarios", "f_det", "f_expl", "scored", oracle=f"""WITH {_RUNS}
SELECT transaction_id, id, status, mismatch FROM marked""")
def _(spark, d):
    return _scenario_runs(spark, d).select("transaction_id", "id", "status", "mismatch")


@query("scenario_summary", "f_scenarios", "f_det", "f_expl", "scored", oracle=f"""WITH {_RUNS}
SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status IN ('ERROR', 'DEGRADED')) AS errors,
  count(mismatch) AS mismatches FROM marked""")
def _(spark, d):
    return J.scenario_summary(_scenario_runs(spark, d))


# --- routing --------------------------------------------------------------------------


@query("decide", "f_expl", oracle="""
SELECT transaction_id, fraud_probability >= 0.5e0 AS is_fraud_predicted,
  CASE WHEN fraud_probability > 0.8e0 OR fraud_probability < 0.2e0 THEN 'high'
    WHEN fraud_probability >= 0.6e0 OR fraud_probability < 0.4e0 THEN 'medium' ELSE 'low' END AS confidence_tier FROM f_expl""")
def _(spark, d):
    from riskloom.operators.train import decide

    return decide(b.f_expl(spark, d).select("transaction_id", "fraud_probability")).select(
        "transaction_id", "is_fraud_predicted", "confidence_tier"
    )


def _recorded_errors(spark, d):
    """Stage errors straight from the recorded tables, each nullable."""
    i = F.col("transaction_id").cast("bigint")
    broken = check_explanation(b.f_expl(spark, d))
    rows = broken.join(b.f_scores(spark, d).select("transaction_id", F.col("message").alias("judge")), "transaction_id")
    return rows.select(
        "transaction_id",
        F.when(i % 97 == 0, "injection").alias("sanitize_error"),
        F.when(i % 127 == 0, "probability out of range").alias("detect_error"),
        F.when(F.size("violations") > 0, F.array_join("violations", ",")).alias("explain_error"),
        F.col("judge").alias("evaluate_error"),
        F.struct(F.col("fraud_probability")).alias("detection"),
        F.struct(F.col("explanation_text")).alias("explanation"),
        F.when(F.col("explanation_generated"), F.struct(F.lit(1).alias("judged"))).alias("evaluation"),
    )


_LEAK = (
    "e.target_audience = 'customer' AND e.explanation_generated AND (contains(e.explanation_text, printf('%.0f%%', e.fraud_probability * 100))"
    " OR contains(e.explanation_text, CAST(e.fraud_probability AS VARCHAR)))"
)
_ERRORS = f"""
broken AS (SELECT e.*, CAST(e.transaction_id AS BIGINT) AS i, v.message AS judge, array_to_string(list_filter([
    CASE WHEN CAST(e.transaction_id AS BIGINT) % 19 = 0 THEN 'words' END,
    CASE WHEN e.uncertainty_flag AND e.explanation_generated AND e.uncertainty_disclosure IS NULL THEN 'disclosure' END,
    CASE WHEN {_LEAK} THEN 'leak' END,
    CASE WHEN e.explanation_generated AND e.token_cost_usd = 0 THEN 'cost' END], lambda x: x IS NOT NULL), ',') AS rules
  FROM f_expl e JOIN f_scores v USING (transaction_id)),
failed AS (SELECT *, CASE WHEN i % 97 = 0 THEN 'sanitize' WHEN i % 127 = 0 THEN 'detect' WHEN rules <> '' THEN 'explain'
    WHEN judge IS NOT NULL THEN 'evaluate' END AS error_stage,
  CASE WHEN i % 97 = 0 THEN 'injection' WHEN i % 127 = 0 THEN 'probability out of range' WHEN rules <> '' THEN rules ELSE judge END AS error
  FROM broken)"""


@query("route", "f_expl", "f_scores", oracle=f"""WITH {_ERRORS}
SELECT transaction_id, error_stage, error, true AS completed,
  error_stage IS NULL OR error_stage NOT IN ('sanitize', 'detect') AS has_detection,
  error_stage IS NULL OR error_stage = 'evaluate' AS has_explanation,
  error_stage IS NULL AND explanation_generated AS has_evaluation FROM failed""")
def _(spark, d):
    routed = R.route(_recorded_errors(spark, d))
    has = [F.col(c).isNotNull().alias(f"has_{c}") for c in ("detection", "explanation", "evaluation")]
    return routed.select("transaction_id", "error_stage", "error", "completed", *has)


@query("stage_events", "f_expl", "f_scores", oracle=f"""WITH {_ERRORS}
SELECT transaction_id, CAST(e.seq AS INT) AS seq, e.event AS event, CASE WHEN e.event = 'error' THEN error END AS error,
  CASE e.event WHEN 'error' THEN error_stage WHEN 'sanitize' THEN 'ok' WHEN 'complete' THEN CASE WHEN error_stage IS NULL THEN 'true' ELSE 'false' END END AS detail
FROM (SELECT *, unnest(list_filter([
    CASE WHEN error_stage IS DISTINCT FROM 'sanitize' THEN {{'seq': 1, 'event': 'sanitize'}} END,
    CASE WHEN error_stage IS NULL OR error_stage NOT IN ('sanitize','detect') THEN {{'seq': 2, 'event': 'detection'}} END,
    CASE WHEN error_stage IS NULL OR error_stage = 'evaluate' THEN {{'seq': 3, 'event': 'explanation'}} END,
    CASE WHEN error_stage IS NULL AND explanation_generated THEN {{'seq': 4, 'event': 'evaluation'}} END,
    CASE WHEN error_stage IS NOT NULL THEN {{'seq': 5, 'event': 'error'}} END,
    CASE WHEN error_stage IS NULL OR error_stage = 'evaluate' THEN {{'seq': 6, 'event': 'complete'}} END],
    lambda x: x IS NOT NULL)) AS e FROM failed)""")
def _(spark, d):
    events = R.stage_events(R.route(_recorded_errors(spark, d), streamed=True))
    detail = (
        F.when(F.col("event") == "error", F.get_json_object("data", "$.error_stage"))
        .when(F.col("event") == "sanitize", F.get_json_object("data", "$.status"))
        .when(F.col("event") == "complete", F.get_json_object("data", "$.completed"))
    )
    error = F.get_json_object("data", "$.error").alias("error")  # null in the record of a failed evaluation
    return events.select("transaction_id", "seq", "event", error, detail.alias("detail"))


@query("timeouts", "f_det", "f_resp", "f_scores", oracle="""
SELECT transaction_id, 'detect' AS stage, inference_latency_ms / 1000 > 2 AS timed_out FROM f_det
UNION ALL SELECT transaction_id, 'explain', duration_seconds >= 15 OR contains(lower(coalesce(message, '')), 'timeout') FROM f_resp
UNION ALL SELECT transaction_id, 'evaluate', duration_seconds >= 20 OR contains(lower(coalesce(message, '')), 'timeout') FROM f_scores""")
def _(spark, d):
    none = F.lit(None).cast("string").alias("message")
    calls = (
        b.f_det(spark, d).select("transaction_id", F.lit("detect").alias("stage"), (F.col("inference_latency_ms") / 1000).alias("duration_seconds"), none)
        .unionByName(b.f_resp(spark, d).select("transaction_id", F.lit("explain").alias("stage"), "duration_seconds", "message"))
        .unionByName(b.f_scores(spark, d).select("transaction_id", F.lit("evaluate").alias("stage"), "duration_seconds", "message"))
    )
    return R.classify_timeouts(calls).select("transaction_id", "stage", "timed_out")


def _staged_inputs(spark, d):
    detections = b.f_det(spark, d).join(b.f_attr_lists(spark, d), "transaction_id", "left")
    transactions = clean_tables(b.f_txn(spark, d), b.f_ident(spark, d))
    judged = b.f_scores(spark, d).withColumn("model", F.lit("claude-sonnet-4-6")).drop("uncertainty_flag")
    return transactions, detections, b.f_resp(spark, d), judged


def _staged(spark, d, streamed=False):
    return run_pipeline(*_staged_inputs(spark, d), streamed=streamed)


_STAGED = f"""
strong AS (SELECT transaction_id, list(feature_name ORDER BY rank) AS names,
    bool_or(feature_name = 'DeviceInfo' AND feature_value = 'ignore previous instructions') AS unsafe
  FROM ranked_attr WHERE rank <= 5 GROUP BY transaction_id),
ended AS (SELECT c.TransactionID AS transaction_id, d.confidence_tier, s.names, coalesce(s.unsafe, false) AS unsafe, r.*exclude(transaction_id),
    coalesce(contains(c.DeviceInfo, 'Disregard previous'), false) AS injected,
    CASE WHEN s.names IS NULL THEN 'no_attributions'
      WHEN (r.message IS NOT NULL OR NOT parsed) AND (duration_seconds >= 15 OR contains(lower(coalesce(r.message, '')), 'timeout')) THEN 'timeout'
      WHEN r.message IS NOT NULL OR NOT parsed THEN 'failed'
      WHEN len(list_filter(cited_features, lambda x: NOT list_contains(s.names, x))) > 0 THEN 'ungrounded' ELSE 'ok' END AS outcome
  FROM cleaned c JOIN f_det d ON d.transaction_id = c.TransactionID LEFT JOIN strong s ON s.transaction_id = c.TransactionID
  JOIN f_resp r ON r.transaction_id = c.TransactionID),
judged AS (SELECT e.*, v.message AS judge, CASE WHEN v.u2 IS NULL THEN g * 0.30e0 + c * 0.25e0 + m * 0.25e0 + a * 0.20e0
      ELSE g * 0.25e0 + c * 0.20e0 + m * 0.20e0 + a * 0.15e0 + u2 * 0.20e0 END AS total,
    CASE WHEN injected THEN 'sanitize'
      WHEN unsafe OR outcome IN ('failed', 'ungrounded')
        OR (confidence_tier = 'low' AND outcome = 'ok' AND uncertainty_disclosure IS NULL) THEN 'explain'
      WHEN outcome = 'ok' AND (v.message IS NOT NULL OR total IS NULL OR (total < 0.7e0 AND round(total, 4) >= 0.7e0)) THEN 'evaluate'
      END AS error_stage
  FROM ended e JOIN (SELECT s.*, CASE WHEN t.confidence_tier = 'low' AND s.uncertainty_handling_score IS NOT NULL
      THEN greatest(0e0, least(1e0, s.uncertainty_handling_score)) END AS u2
    FROM scored s JOIN f_det t USING (transaction_id)) v USING (transaction_id))"""


@query("run_stages", "cleaned", "f_det", "ranked_attr", "f_resp", "scored", oracle=f"""WITH {_STAGED}
SELECT transaction_id, error_stage, true AS completed,
  CASE WHEN error_stage IS NULL OR error_stage = 'evaluate' THEN
    CASE outcome WHEN 'no_attributions' THEN 'insufficient_shap_data' WHEN 'timeout' THEN 'llm_timeout' END END AS warning,
  CASE WHEN error_stage IS NULL AND outcome = 'ok' THEN {rounded('total', 4)} END AS overall_score,
  CASE WHEN error_stage IS NULL AND outcome = 'ok' THEN total >= 0.70e0 END AS passed FROM judged""")
def _(spark, d):
    return _staged(spark, d).select(
        "transaction_id", "error_stage", "completed", "explanation.warning", "evaluation.overall_score", "evaluation.passed"
    )


@query("calls_of_run", "cleaned", "f_det", "ranked_attr", "f_resp", "scored", oracle=f"""WITH {_STAGED}
SELECT transaction_id, 'phase_3' AS phase, 'ExplanationAgent' AS agent_name, CASE WHEN outcome = 'timeout' THEN 0 ELSE input_tokens END AS input_tokens,
  CASE WHEN outcome = 'timeout' THEN 0 ELSE output_tokens END AS output_tokens, fraud_probability AS confidence, CAST(NULL AS BOOLEAN) AS passed
FROM judged JOIN (SELECT transaction_id, fraud_probability FROM f_det) USING (transaction_id)
WHERE NOT injected AND NOT unsafe AND outcome IN ('ok', 'ungrounded', 'timeout')
UNION ALL SELECT transaction_id, 'phase_4', 'EvalAgent', CASE WHEN judge IS NULL THEN v.input_tokens ELSE 0 END,
  CASE WHEN judge IS NULL THEN v.output_tokens ELSE 0 END, CASE WHEN judge IS NULL THEN {rounded('total', 4)} END, CASE WHEN judge IS NULL THEN total >= 0.70e0 END
FROM judged j JOIN (SELECT transaction_id, input_tokens, output_tokens FROM f_scores) v USING (transaction_id)
WHERE (error_stage IS NULL OR error_stage = 'evaluate') AND outcome = 'ok'""")
def _(spark, d):
    """As the log records them; what a call costs is priced as for every record."""
    log = A.call_records(calls_of_run(*_staged_inputs(spark, d)).withColumn("timestamp", F.lit(None).cast("timestamp")))
    return log.select("transaction_id", "phase", "agent_name", "input_tokens", "output_tokens", "confidence", "passed")


@query("poor_explanations", "f_det", "ranked_attr", oracle="""
SELECT transaction_id, 'analyst' AS target_audience, 'Looks odd.' AS explanation_text, ['TransactionAmt'] AS cited_features,
  coalesce((SELECT list(feature_name ORDER BY rank) FROM ranked_attr r WHERE r.rank <= 5 AND r.transaction_id = d.transaction_id
    AND feature_name <> 'TransactionAmt'), []) AS uncited_features,
  confidence_tier = 'low' AS uncertainty_flag, CASE WHEN confidence_tier = 'low' THEN 'Low confidence.' END AS uncertainty_disclosure
FROM f_det d WHERE CAST(transaction_id AS BIGINT) % 3 = 0 AND transaction_id IN (SELECT transaction_id FROM ranked_attr)""")
def _(spark, d):
    """Every third transaction stands for a scenario that prescribes its explanation."""
    detections = b.f_det(spark, d).join(b.f_attr_lists(spark, d), "transaction_id")
    scenarios = detections.select(
        "transaction_id", F.lit("analyst").alias("target_audience"),
        F.when(F.col("transaction_id").cast("bigint") % 3 == 0, "Looks odd.").alias("inject_poor_explanation"),
    )
    return J.poor_explanations(scenarios, detections).select(
        "transaction_id", "target_audience", "explanation_text", "cited_features", "uncited_features", "uncertainty_flag", "uncertainty_disclosure"
    )


@query("result_json", "cleaned", "f_det", "ranked_attr", "f_resp", "scored", oracle=f"""WITH {_STAGED}
SELECT transaction_id, 'true' AS completed, error_stage,
  error_stage IS DISTINCT FROM 'sanitize' AS has_detection, error_stage IS NULL OR error_stage = 'evaluate' AS has_explanation,
  error_stage IS NULL AND outcome = 'ok' AS has_evaluation, true AS every_field FROM judged""")
def _(spark, d):
    """Read back from the JSON text: every field is there, null or not."""
    out = R.result_json(_staged(spark, d))
    fields = "transaction_id completed detection_result explanation_result eval_result error error_stage".split()
    every = F.json_object_keys("result") == F.array(*[F.lit(f) for f in fields])
    # One pass over the text for all fields.
    read = out.select("transaction_id", every.alias("every_field"), F.json_tuple("result", *fields[1:]).alias(*fields[1:]))
    return read.select(
        "transaction_id", "completed", "error_stage", F.col("detection_result").isNotNull().alias("has_detection"),
        F.col("explanation_result").isNotNull().alias("has_explanation"), F.col("eval_result").isNotNull().alias("has_evaluation"),
        "every_field",
    )


# --- costs ----------------------------------------------------------------------------


# Recorded costs are whole multiples of 1e-8: added as whole numbers the order does not matter.
_UNITS = "CAST(round(cost_usd * 1e8) AS BIGINT)"
_SPEND = f"CAST(sum({_UNITS}) AS DOUBLE) / 1e8"
_SPENT_BY = f"coalesce(CAST(sum({_UNITS}) FILTER (agent_name = '{{}}') AS DOUBLE) / 1e8, 0)"


def _records(spark, d):
    return A.call_records(b.f_calls(spark, d))


@query("call_records", "records", oracle="""
SELECT call_id, timestamp, transaction_id, phase, agent_name, model, tier, input_tokens, output_tokens, cost_usd, duration_seconds,
  CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BOOLEAN) AS passed, budget_breached FROM records""")
def _(spark, d):
    return _records(spark, d)


@query("routing_tier", "records", oracle="SELECT model, tier, count(*) AS calls FROM records GROUP BY model, tier")
def _(spark, d):
    return _records(spark, d).groupBy("model", "tier").agg(F.count("*").alias("calls"))


@query("budget_breaches", "records", oracle="SELECT call_id, agent_name, cost_usd FROM records WHERE budget_breached")
def _(spark, d):
    return A.budget_breaches(_records(spark, d)).select("call_id", "agent_name", "cost_usd")


@query("cost_totals", "records", oracle=f"""
SELECT {rounded(f'{_SPEND}', 6)} AS total_cost, count(*) AS calls, count(DISTINCT transaction_id) AS transactions,
  {rounded(f'{_SPEND} / count(DISTINCT transaction_id)', 6)} AS average_per_transaction,
  {rounded(f'{_SPEND} / count(DISTINCT transaction_id) * 100', 4)} AS projected_per_100,
  count(*) FILTER (budget_breached) AS budget_breaches FROM records""")
def _(spark, d):
    return A.cost_totals(_records(spark, d))


@query("cost_by_phase", "records", oracle=f"""
SELECT coalesce(phase, 'unknown') AS phase, {rounded(f'{_SPEND}', 6)} AS cost FROM records GROUP BY 1 ORDER BY 1""")
def _(spark, d):
    return A.cost_by_phase(_records(spark, d))


@query("cost_by_agent", "records", oracle=f"""
SELECT agent_name, count(*) AS calls, {rounded(f'{_SPEND}', 6)} AS cost, {rounded(f'{_SPEND} / count(*)', 8)} AS average_per_call
FROM records GROUP BY agent_name""")
def _(spark, d):
    return A.cost_by_agent(_records(spark, d))


@query("tier_mix", "records", oracle=f"""
SELECT {rounded("count(*) FILTER (tier = 'cheap') * 100e0 / count(*)", 6)} AS cheap_percent,
  {rounded("100 - count(*) FILTER (tier = 'cheap') * 100e0 / count(*)", 6)} AS strong_percent FROM records""")
def _(spark, d):
    return A.tier_mix(_records(spark, d))


def _report(condition: str) -> str:
    parts = []
    for section, name in (("total", "'all'"), ("phase", "coalesce(phase, 'unknown')"), ("agent", "agent_name"), ("tier", "tier")):
        parts.append(f"""SELECT '{section}' AS section, {name} AS name, count(*) AS calls, count(DISTINCT transaction_id) AS transactions,
  {rounded(f'{_SPEND}', 6)} AS cost, {rounded(f'{_SPEND} / count(*)', 8)} AS average_per_call,
  {rounded(f'{_SPEND} / count(DISTINCT transaction_id)', 6)} AS average_per_transaction,
  {rounded(f'{_SPEND} / count(DISTINCT transaction_id) * 100', 4)} AS projected_per_100,
  {rounded(f'count(*) * 100e0 / (SELECT count(*) FROM records WHERE {condition})', 6)} AS percent_of_calls,
  count(*) FILTER (budget_breached) AS budget_breaches FROM records WHERE {condition} GROUP BY ALL""")
    return "\nUNION ALL ".join(parts)


@query("cost_report", "records", oracle=_report("true"))
def _(spark, d):
    return A.cost_report(_records(spark, d))


@query("cost_report_phase", "records", oracle=_report("phase = 'phase_2'"))
def _(spark, d):
    return A.cost_report(_records(spark, d), "phase_2")


@query("budget_per_transaction", "records", oracle=f"""
SELECT transaction_id, {rounded('e', 6)} AS explanation_cost, {rounded('v', 6)} AS evaluation_cost, {rounded('t', 6)} AS total_cost,
  e > 0.03e0 AS explanation_over, v > 0.05e0 AS evaluation_over, t > 0.08e0 AS total_over
FROM (SELECT transaction_id, {_SPENT_BY.format('ExplanationAgent')} AS e, {_SPENT_BY.format('EvalAgent')} AS v, {_SPEND} AS t
  FROM records GROUP BY transaction_id)""")
def _(spark, d):
    return A.budget_per_transaction(_records(spark, d))


@query("breaches_by_agent", "records", oracle="""
SELECT agent_name, count(*) FILTER (budget_breached) AS budget_breaches FROM records GROUP BY agent_name""")
def _(spark, d):
    return A.breaches_by_agent(_records(spark, d))


@query("routing_by_agent_tier", "records", oracle="SELECT agent_name, tier, count(*) AS calls FROM records GROUP BY agent_name, tier")
def _(spark, d):
    return A.routing_by_agent_tier(_records(spark, d))


# --- metrics --------------------------------------------------------------------------


@query("token_counters", "f_calls", oracle="""
SELECT agent_name, model, 'input' AS token_type, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM f_calls GROUP BY ALL
UNION ALL SELECT agent_name, model, 'output', CAST(sum(output_tokens) AS BIGINT) FROM f_calls GROUP BY ALL""")
def _(spark, d):
    return M.token_counters(b.f_calls(spark, d))


def _buckets(value: str, bounds: list[float], source: str, by: str, digits: int, total: str = "") -> str:
    keep = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {keep}'{label}' AS le, count(*) FILTER ({condition}) AS at_most, {rounded(total or f'sum({value})', digits)} AS total, "
        f"count({value}) AS count FROM {source} {group}"
        for label, condition in [*((f"{x:g}", f"{value} <= {x}e0") for x in bounds), ("+Inf", f"{value} IS NOT NULL")]
    ]
    return " UNION ALL ".join(parts)


@query("cost_histogram", "priced", oracle=_buckets(
    "raw_cost_usd", fixed.COST_BUCKETS, "priced", "", 6,
    total="CAST(sum(CAST(round(raw_cost_usd * 1e9) AS BIGINT)) AS DOUBLE) / 1e9"))
def _(spark, d):
    return M.cost_histogram(price_calls(b.f_calls(spark, d)))


@query("latency_histogram", "f_req", oracle=_buckets("duration_s", fixed.LATENCY_BUCKETS, "f_req", "endpoint", 4))
def _(spark, d):
    return M.latency_histogram(b.f_req(spark, d))


def _quantile_sql(value: str, bounds: list[float], source: str, by: str, quantiles: list[int]) -> str:
    """Rank per group, the first bucket that reaches it, straight-line interpolation."""
    listed = ", ".join(f"({i}, {x}e0, {bounds[i - 1] if i else 0}e0)" for i, x in enumerate(bounds))
    columns = ", ".join(
        f"CAST(printf('%.6f', max(v) FILTER (q = {q})) AS DOUBLE) AS p{q}" for q in quantiles
    )
    asked = ", ".join(f"({q})" for q in quantiles)
    return f"""WITH limits(i, high, low) AS (VALUES {listed}), asked(q) AS (VALUES {asked}),
values_ AS (SELECT {by} AS g, {value} AS x FROM {source}),
totals AS (SELECT g, count(x) AS n FROM values_ GROUP BY g),
cumulative AS (SELECT v.g, i, high, low, count(*) FILTER (x <= high) AS c FROM values_ v, limits GROUP BY ALL),
steps AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY g ORDER BY i), 0) AS before FROM cumulative),
found AS (SELECT t.g, q, n, (SELECT low + (high - low) * (((q / 100e0) * n - before) / (c - before)) FROM steps s
    WHERE s.g = t.g AND c >= (q / 100e0) * n ORDER BY i LIMIT 1) AS inside FROM totals t, asked)
SELECT g AS {{name}}, {columns} FROM (SELECT g, q, coalesce(inside, {bounds[-1]}e0) AS v FROM found) GROUP BY g"""


@query("histogram_quantile", "f_req", oracle=_quantile_sql(
    "duration_s", fixed.LATENCY_BUCKETS, "f_req", "endpoint", [50, 95, 99]).replace("{name}", "endpoint"))
def _(spark, d):
    hist = M.histogram(b.f_req(spark, d), "duration_s", fixed.LATENCY_BUCKETS, "endpoint")
    return M.histogram_quantiles(hist, fixed.LATENCY_BUCKETS, [0.50, 0.95, 0.99])


@query("request_counters", "f_req", oracle="""
SELECT endpoint, method, status_code, count(*) AS requests FROM f_req GROUP BY ALL""")
def _(spark, d):
    return M.request_counters(b.f_req(spark, d))


@query("windowed_token_rate", "f_calls", oracle=f"""
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, agent_name, {rounded('sum(input_tokens + output_tokens) / 3600e0', 6)} AS rate
FROM f_calls GROUP BY ALL""")
def _(spark, d):
    return M.token_rate(b.f_calls(spark, d), 3600)


@query("sliding_request_rate", "f_req", oracle=f"""
SELECT time_bucket(INTERVAL 15 MINUTE, ts) - s * INTERVAL 15 MINUTE AS window_start, {rounded('count(*) / 3600e0', 6)} AS rate
FROM f_req, (VALUES (0), (1), (2), (3)) shifts(s) GROUP BY 1""")
def _(spark, d):
    return M.request_rate(b.f_req(spark, d), 3600, 900)


@query("windowed_cost_quantiles", "priced", oracle=_quantile_sql(
    "raw_cost_usd", fixed.COST_BUCKETS, "priced", "time_bucket(INTERVAL 1 HOUR, timestamp)", [50, 95, 99]).replace("{name}", "window_start"))
def _(spark, d):
    return M.windowed_cost_quantiles(price_calls(b.f_calls(spark, d)), 3600)


@query("windowed_latency_p95", "f_calls", oracle=_quantile_sql(
    "duration_seconds", fixed.LATENCY_BUCKETS, "f_calls", "time_bucket(INTERVAL 1 HOUR, timestamp)", [95]).replace("{name}", "window_start"))
def _(spark, d):
    return M.windowed_latency_p95(b.f_calls(spark, d), 3600)


@query("stat_panels", "records", oracle=f"""
SELECT 'total_cost' AS panel, {rounded(f'{_SPEND}', 6)} AS value FROM records
UNION ALL SELECT 'budget_breaches', CAST(count(*) FILTER (budget_breached) AS DOUBLE) FROM records
UNION ALL SELECT 'calls_cheap', CAST(count(*) FILTER (tier = 'cheap') AS DOUBLE) FROM records
UNION ALL SELECT 'calls_strong', CAST(count(*) FILTER (tier = 'strong') AS DOUBLE) FROM records""")
def _(spark, d):
    return M.stat_panels(_records(spark, d))


@query("rate_limit", "f_req", oracle="""
SELECT request_id, client, endpoint, counts AND n > 3 AS limited, CASE WHEN counts AND n > 3 THEN 429 ELSE status_code END AS status_code
FROM (SELECT *, row_number() OVER (PARTITION BY client, endpoint, counts, date_trunc('day', ts) ORDER BY ts, request_id) AS n
  FROM (SELECT *, endpoint LIKE '/api/v1/analyze%' AND status_code <> 401 AS counts FROM f_req))""")
def _(spark, d):
    limited = M.rate_limit(b.f_req(spark, d), limit=3, unit="day")
    return limited.select("request_id", "client", "endpoint", "limited", "status_code")
