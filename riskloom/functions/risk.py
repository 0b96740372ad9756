"""Column rules shared by detection, explanation and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed


def confidence_tier(p: Column) -> Column:
    """How far a probability is from the undecided middle."""
    return (
        F.when((p > 0.8) | (p < 0.2), "high")
        .when((p >= 0.6) | (p < 0.4), "medium")
        .otherwise("low")
    )


def fraud_flag(p: Column, threshold: float = fixed.FRAUD_THRESHOLD) -> Column:
    return p >= F.lit(threshold)


def routing_tier(model: Column) -> Column:
    strong = F.lit(False)
    for mark in fixed.STRONG_MODEL_MARKS:
        strong = strong | F.contains(model, F.lit(mark))
    return F.when(strong, "strong").otherwise("cheap")


def overall_score(scores: dict[str, Column]) -> Column:
    """Weighted rubric score; the five-part weights apply when an uncertainty score is there."""

    def weighted(weights: dict[str, float]) -> Column:
        total = None
        for name, weight in weights.items():
            term = scores[name] * F.lit(weight)
            total = term if total is None else total + term
        return total

    return F.when(
        scores["uncertainty_handling"].isNotNull(), weighted(fixed.RUBRIC_UNCERTAIN)
    ).otherwise(weighted(fixed.RUBRIC))


def timed_out(duration: Column, message: Column, limit: float) -> Column:
    """A failed remote call counts as timed out by its duration or by its message."""
    slow = F.coalesce(duration >= F.lit(limit), F.lit(False))
    said = F.coalesce(F.contains(F.lower(message), F.lit("timeout")), F.lit(False))
    return slow | said


def ranked_attributions(features: Column, k: int, ties: str = "late") -> Column:
    """The k entries with the largest absolute attribution, in descending order.

    Among equals, ``late`` puts the higher position of the input array first and
    ``early`` the lower one.
    """
    sign = 1 if ties == "late" else -1
    keyed = F.transform(
        features,
        lambda f, i: F.struct(F.abs(f["shap_value"]).alias("size"), (i * sign).alias("at"), f.alias("f")),
    )
    ordered = F.reverse(F.array_sort(keyed))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["f"])


def missing_from(items: Column, known: Column) -> Column:
    """Items that are not in ``known``; keeps order and repeats, unlike ``array_except``."""
    return F.filter(items, lambda x: ~F.array_contains(known, x))
