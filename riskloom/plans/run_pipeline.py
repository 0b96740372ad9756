"""The whole pipeline as a table job: screen, detect, explain, evaluate, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom import schemas
from riskloom.functions.risk import timed_out
from riskloom.operators.checks import check_eval, check_explanation
from riskloom.operators.explain import explanation_records
from riskloom.operators.join import price_calls
from riskloom.operators.routing import injection_error, route, ungrounded_error
from riskloom.operators.safety import scan_attribution_values, scan_fields
from riskloom.operators.scoring import score
from riskloom.session import settle

_RECORD = schemas.EXPLANATION.fieldNames()
_SCORES = [
    "grounding_score", "clarity_score", "completeness_score", "audience_appropriateness_score",
    "uncertainty_handling_score", "overall_score",
]


def _whole(df: DataFrame, name: str) -> DataFrame:
    """The table as (transaction_id, one struct)."""
    return df.select("transaction_id", F.struct(*df.columns).alias(name))


def _explain(wide: DataFrame, audience: str) -> DataFrame:
    """Adds ``explanation`` and ``explain_error``; takes the structs detection and response."""
    flat = wide.select(
        "transaction_id", "sanitize_error", "detection",
        "detection.fraud_probability", "detection.is_fraud_predicted", "detection.confidence_tier",
        "detection.top_shap_features", "response.response_text", "response.model", "response.input_tokens",
        "response.output_tokens", "response.duration_seconds", "response.message",
    )
    records = check_explanation(
        explanation_records(
            scan_attribution_values(flat), audience, "sanitize_error", "detection", "unsafe_attribution"
        )
    )
    error = F.coalesce(
        F.when(F.col("unsafe_attribution"), "injection in an attribution value"),
        F.when(F.col("outcome") == "failed", "explanation call failed"),
        F.when(F.col("outcome") == "ungrounded", ungrounded_error(F.col("hallucinated_features"))),
        F.when(F.size("violations") > 0, F.concat(F.lit("explanation breaks: "), F.array_join("violations", ", "))),
    )
    return records.select(
        "transaction_id", "sanitize_error", "detection",
        F.struct(*_RECORD).alias("explanation"), error.alias("explain_error"),
        # A call is made if there are safe attributions to explain.
        F.when(~F.col("unsafe_attribution"), F.col("outcome")).alias("called"),
    )


def evaluation_error(duration: Column, message: Column) -> Column:
    slow = timed_out(duration, message, fixed.EVALUATION_LIMIT_S)
    return F.when(message.isNotNull(), F.when(slow, "evaluation timed out").otherwise(message))


def _evaluate(explained: DataFrame) -> DataFrame:
    """Adds ``evaluation`` and ``evaluate_error``; takes explanation and the struct judged."""
    carried = ["transaction_id", "sanitize_error", "detection", "explanation", "explain_error"]
    flat = explained.select(
        *carried, "explanation.target_audience", "explanation.uncertainty_flag",
        *[F.col(f"judged.{c}") for c in (*_SCORES[:5], "failure_reasons", "model", "input_tokens", "output_tokens")],
        F.col("judged.duration_seconds").alias("judge_seconds"), F.col("judged.message").alias("judge_message"),
        (F.col("judged").isNotNull() & F.col("explanation.explanation_generated")).alias("to_judge"),
    )
    scored = check_eval(price_calls(flat).transform(score).withColumn("token_cost_usd", F.col("raw_cost_usd")))
    record = F.struct(
        "transaction_id", "target_audience", *_SCORES, F.lit(fixed.PASS_MARK).alias("pass_threshold"), "passed",
        "failure_reasons", "token_cost_usd",
    )
    error = F.coalesce(
        evaluation_error(F.col("judge_seconds"), F.col("judge_message")),
        F.when(F.size("violations") > 0, F.concat(F.lit("evaluation breaks: "), F.array_join("violations", ", "))),
    )
    return scored.select(
        *carried,
        F.when(F.col("to_judge"), record).alias("evaluation"),
        F.when(F.col("to_judge"), error).alias("evaluate_error"),
    )


def calls_of_run(
    transactions: DataFrame, detections: DataFrame, responses: DataFrame, judged: DataFrame, *, audience: str = "analyst"
) -> DataFrame:
    """The calls a run makes, one row each, as ``call_records`` takes them.

    An explanation call carries the probability as its confidence, an evaluation its rounded
    score and whether it passed. A call that timed out, and any failed evaluation, is logged
    with no tokens; an explanation call that failed otherwise leaves no record.
    """
    explained = _screened_and_explained(transactions, detections, responses, audience)
    # Both kinds of calls start from these rows: screened, joined and explained once.
    reached = settle(
        explained.filter(F.col("sanitize_error").isNull() & F.col("detection").isNotNull()).select(
            "transaction_id", "called", "explain_error", "detection.fraud_probability", "explanation.explanation_generated",
            "explanation.uncertainty_flag", "explanation.target_audience",
        )
    )
    none = F.lit(None)
    ended = F.col("called") == "timeout"
    asked = responses.select("transaction_id", "model", "input_tokens", "output_tokens", "duration_seconds")
    first = reached.filter(F.col("called").isin("ok", "ungrounded", "timeout")).join(asked, "transaction_id").select(
        "transaction_id", F.lit("phase_3").alias("phase"), F.lit("ExplanationAgent").alias("agent_name"), "model",
        F.when(ended, 0).otherwise(F.col("input_tokens")).cast("long").alias("input_tokens"),
        F.when(ended, 0).otherwise(F.col("output_tokens")).cast("long").alias("output_tokens"),
        F.col("duration_seconds").cast("double").alias("duration_seconds"),
        F.col("fraud_probability").alias("confidence"), none.cast("boolean").alias("passed"),
    )
    failed = F.col("message").isNotNull()
    scored = (
        reached.filter(F.col("explain_error").isNull() & F.col("explanation_generated"))
        .select("transaction_id", "uncertainty_flag", "target_audience")
        .join(judged, "transaction_id").transform(score)
    )
    second = scored.select(
        "transaction_id", F.lit("phase_4").alias("phase"), F.lit("EvalAgent").alias("agent_name"), "model",
        F.when(failed, 0).otherwise(F.col("input_tokens")).cast("long").alias("input_tokens"),
        F.when(failed, 0).otherwise(F.col("output_tokens")).cast("long").alias("output_tokens"),
        F.col("duration_seconds").cast("double").alias("duration_seconds"),
        F.when(~failed, F.col("overall_score")).alias("confidence"), F.when(~failed, F.col("passed")).alias("passed"),
    )
    return first.unionByName(second)


def _screened_and_explained(transactions: DataFrame, detections: DataFrame, responses: DataFrame, audience: str) -> DataFrame:
    row_id = F.col(fixed.ROW_ID).cast("string").alias("transaction_id")
    screened = scan_fields(transactions).select(row_id, injection_error(F.col("injection")).alias("sanitize_error"))
    wide = (
        screened.join(_whole(detections, "detection"), "transaction_id", "left")
        .join(_whole(responses, "response"), "transaction_id", "left")
    )
    return _explain(wide, audience)


def run_pipeline(
    transactions: DataFrame,
    detections: DataFrame,
    responses: DataFrame,
    judged: DataFrame,
    *,
    audience: str = "analyst",
    streamed: bool = False,
) -> DataFrame:
    """One routed row per transaction with nested results, ``error``, ``error_stage``, ``completed``.

    The remote calls enter as recorded responses. Each table is brought in once, all on the
    transaction id, and just before it is needed: a join keeps the optimizer from inlining the
    explanation's expressions into every use of them in the evaluation. The rest is row by row. A row that breaks a rule
    of the explanation record, or whose attribution values carry an injection, ends in the
    explain stage: a table job cannot raise for single rows.
    """
    explained = _screened_and_explained(transactions, detections, responses, audience)
    explained = explained.join(_whole(judged, "judged"), "transaction_id", "left")
    ready = _evaluate(explained).withColumn(
        "detect_error", F.when(F.col("detection").isNull(), "no detection")
    )
    return route(ready, streamed=streamed).select(
        "transaction_id", "detection", "explanation", "evaluation", "error", "error_stage", "completed"
    )
