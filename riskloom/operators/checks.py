"""Declarative record checks: every row gets the names of the rules it breaks.

A check adds one array column ``violations`` in a single pass of built-in expressions;
``valid_rows`` and ``quarantine`` split on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import percent_text, short_text
from riskloom.functions.risk import confidence_tier, fraud_flag
from riskloom.functions.text import strip, word_count


def with_violations(df: DataFrame, rules: dict[str, Column], column: str = "violations") -> DataFrame:
    """``rules`` maps a name to the condition that is true for a bad row."""
    names = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return df.withColumn(column, F.array_compact(F.array(*names)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def _outside(name: str, allowed: list[str], required: bool = False) -> Column:
    c = F.col(name)
    return c.isNull() | ~c.isin(*allowed) if required else c.isNotNull() & ~c.isin(*allowed)


def _not_unit(name: str) -> Column:
    return F.col(name).isNull() | ~F.col(name).between(0.0, 1.0)


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def cut_long_text(df: DataFrame) -> DataFrame:
    present = [n for n in fixed.FREE_TEXT if n in df.columns]
    return df.withColumns({n: F.substring(n, 1, fixed.TEXT_LIMIT) for n in present})


def check_transaction(df: DataFrame) -> DataFrame:
    """Rules of a single transaction; long free text is cut, not rejected."""

    def not_whole(name: str) -> Column:
        return F.col(name).isNotNull() & (F.col(name) != F.floor(name))

    return with_violations(
        cut_long_text(df),
        {
            "amount": F.col(fixed.AMOUNT).isNull() | (F.col(fixed.AMOUNT) <= 0),
            "id": F.col(fixed.ROW_ID).isNull() | (strip(F.col(fixed.ROW_ID)) == ""),
            "ProductCD": _outside("ProductCD", fixed.PRODUCT_CODES, required=True),
            "card1": not_whole("card1"),
            "card4": _outside("card4", fixed.CARD_NETWORKS),
            "card6": _outside("card6", fixed.CARD_KINDS),
            "addr1": not_whole("addr1"),
            "DeviceType": _outside("DeviceType", fixed.DEVICE_TYPES),
        },
    )


def check_detection(df: DataFrame, threshold: float = fixed.FRAUD_THRESHOLD) -> DataFrame:
    p = F.col("fraud_probability")
    rules = {
        "probability": _not_unit("fraud_probability"),
        "tier": ~F.col("confidence_tier").eqNullSafe(confidence_tier(p)),
        "flag": ~F.col("is_fraud_predicted").eqNullSafe(fraud_flag(p, threshold)),
    }
    if "top_shap_features" in df.columns:
        rules["attributions"] = F.size("top_shap_features") > fixed.TOP_K
    return with_violations(df, rules)


def reveals_probability(text: Column, p: Column) -> Column:
    """The text contains the probability as whole percent or rounded to four decimals."""
    return F.contains(text, percent_text(p, 0)) | F.contains(text, short_text(p, 4))


def leak(df: DataFrame) -> Column:
    return (
        (F.col("target_audience") == "customer")
        & F.col("explanation_generated")
        & reveals_probability(F.col("explanation_text"), F.col("fraud_probability"))
    )


def check_explanation(df: DataFrame) -> DataFrame:
    made = F.col("explanation_generated")
    rules = {
        "audience": _outside("target_audience", fixed.AUDIENCES, required=True),
        "words": word_count(F.col("explanation_text")) > fixed.MAX_WORDS,
        "disclosure": F.col("uncertainty_flag") & made & _blank("uncertainty_disclosure"),
        "leak": leak(df),
        "cost": made & (F.col("token_cost_usd").isNull() | (F.col("token_cost_usd") == 0.0)),
        "probability": F.col("fraud_probability").isNull(),
        "text": made & F.col("explanation_text").isNull(),
    }
    if "is_fraud_predicted" in df.columns:
        rules["flag"] = F.col("is_fraud_predicted").isNull()
    if "hallucinated_features" in df.columns:
        rules["ungrounded"] = F.size("hallucinated_features") > 0
    return with_violations(df, rules)


def check_probability_leak(df: DataFrame) -> DataFrame:
    return df.withColumn("leaks", F.coalesce(leak(df), F.lit(False)))


def check_eval(df: DataFrame) -> DataFrame:
    scores = [
        "grounding_score", "clarity_score", "completeness_score", "audience_appropriateness_score", "overall_score",
    ]
    threshold = F.col("pass_threshold") if "pass_threshold" in df.columns else F.lit(fixed.PASS_MARK)
    rules = {name: _not_unit(name) for name in scores}
    rules["passed"] = ~F.col("passed").eqNullSafe(F.col("overall_score") >= threshold)
    rules["cost"] = F.col("token_cost_usd").isNull() | (F.col("token_cost_usd") == 0.0)
    return with_violations(df, rules)


def duplicate_ids(df: DataFrame, key: str = fixed.ROW_ID) -> DataFrame:
    """Ids that occur more than once, with their number of rows (combined on the map side)."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def copy_fidelity(explanations: DataFrame, detections: DataFrame) -> DataFrame:
    """Whether each explanation repeats its detection's probability and flag unchanged."""
    d = detections.select(
        "transaction_id", F.col("fraud_probability").alias("__p"), F.col("is_fraud_predicted").alias("__f")
    )
    same_p = F.col("fraud_probability").eqNullSafe(F.col("__p"))
    same_f = F.col("is_fraud_predicted").eqNullSafe(F.col("__f"))
    return (
        explanations.join(d, "transaction_id")
        .withColumns({"same_probability": same_p, "same_flag": same_f})
        .drop("__p", "__f")
    )
