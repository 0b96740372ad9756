"""Rubric scores of explanations and outcomes of scenario runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import clamp01, round_even
from riskloom.functions.risk import overall_score

SCORES = [f"{name}_score" for name in fixed.RUBRIC_UNCERTAIN]


def clamp_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({n: clamp01(F.col(n)) for n in SCORES})


def uncertainty_gate(df: DataFrame) -> DataFrame:
    """The uncertainty score counts only where the explanation was flagged as uncertain."""
    c = "uncertainty_handling_score"
    return df.withColumn(c, F.when(F.col("uncertainty_flag"), F.col(c)))


def with_overall(df: DataFrame) -> DataFrame:
    """Weighted score, unrounded in ``raw_overall`` and to four decimals in ``overall_score``."""
    parts = {name: F.col(f"{name}_score") for name in fixed.RUBRIC_UNCERTAIN}
    return df.withColumn("raw_overall", overall_score(parts)).withColumn(
        "overall_score", round_even(F.col("raw_overall"), 4)
    )


def pass_fail(df: DataFrame) -> DataFrame:
    """Passed iff the unrounded score reaches the mark; a pass carries no failure reasons."""
    passed = F.col("raw_overall") >= F.lit(fixed.PASS_MARK)
    out = df.withColumn("passed", passed)
    if "failure_reasons" in df.columns:
        empty = F.array().cast("array<string>")
        out = out.withColumn("failure_reasons", F.when(F.col("passed"), empty).otherwise(F.col("failure_reasons")))
    return out


def score(df: DataFrame) -> DataFrame:
    """All scoring rules in order."""
    return df.transform(clamp_scores).transform(uncertainty_gate).transform(with_overall).transform(pass_fail)


def generated_only(explanations: DataFrame) -> DataFrame:
    """Explanations to be judged: only those that were generated."""
    return explanations.filter(F.col("explanation_generated"))


def poor_explanations(scenarios: DataFrame, detections: DataFrame) -> DataFrame:
    """Explanation records of the scenarios that prescribe a deliberately poor text.

    The text stands in for a generated explanation that cites the amount only.
    """
    low = F.col("confidence_tier") == "low"
    return scenarios.filter(F.coalesce(F.col("inject_poor_explanation"), F.lit("")) != "").join(detections, "transaction_id").select(
        "transaction_id", "target_audience", "fraud_probability", "is_fraud_predicted",
        F.col("inject_poor_explanation").alias("explanation_text"), F.array(F.lit(fixed.AMOUNT)).alias("cited_features"),
        F.filter(F.col("top_shap_features.feature_name"), lambda n: n != fixed.AMOUNT).alias("uncited_features"),
        F.array().cast("array<string>").alias("hallucinated_features"), low.alias("uncertainty_flag"),
        F.when(low, fixed.POOR_DISCLOSURE).alias("uncertainty_disclosure"), F.lit(True).alias("explanation_generated"),
        F.lit(None).cast("string").alias("warning"), F.lit(fixed.POOR_COST_USD).alias("token_cost_usd"),
        F.lit(1.0).alias("generation_latency_seconds"),
    )


def scenario_status(df: DataFrame) -> DataFrame:
    """Status and expectation mismatch of each scenario.

    Takes skipped, error, explanation_generated, passed, overall_score and the two
    expectations; the message about the minimum score takes precedence.
    """
    status = (
        F.when(F.col("skipped"), "SKIPPED")
        .when(F.col("error").isNotNull(), "ERROR")
        .when(~F.col("explanation_generated"), "DEGRADED")
        .when(F.col("passed"), "PASS")
        .otherwise("FAIL")
    )
    judged = F.col("status").isin("PASS", "FAIL")
    too_low = F.col("overall_score") < F.col("expected_overall_score_min")
    unexpected = F.col("passed") != F.col("expected_eval_passed")
    mismatch = F.when(judged & too_low, "score below minimum").when(judged & unexpected, "passed differs")
    return df.withColumn("status", status).withColumn("mismatch", mismatch)


def scenario_summary(df: DataFrame) -> DataFrame:
    """Counts per outcome; degraded runs count as errors."""
    is_ = F.col("status")
    return df.agg(
        F.count_if(is_ == "PASS").alias("passed"),
        F.count_if(is_ == "FAIL").alias("failed"),
        F.count_if(is_ == "SKIPPED").alias("skipped"),
        F.count_if(is_.isin("ERROR", "DEGRADED")).alias("errors"),
        F.count("mismatch").alias("mismatches"),
    )
