"""Joins between the record tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed


def join_identity(transactions: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Every transaction with its device columns, null where there are none.

    A left equi-join on the id. No hint: the identity table grows with the data, so the
    choice between broadcast and sort-merge, and the split of skewed partitions, is left to
    the adaptive planner, which knows the sizes at run time.
    """
    if identity is None:
        return transactions
    return transactions.join(identity, fixed.ROW_ID, "left")


def identity_coverage(merged: DataFrame) -> DataFrame:
    with_device = F.count("DeviceType") if "DeviceType" in merged.columns else F.lit(0).cast("bigint")
    return merged.agg(F.count("*").alias("transactions"), with_device.alias("with_identity"))


def rate_columns(model: Column, rates: Mapping[str, tuple[float, float]] | None = None) -> tuple[Column, Column]:
    """Input and output price per token of a model name.

    The rate card is a dict on the driver, hence small; as a map literal it needs neither a
    shuffle nor a broadcast, and the hottest model name costs no more than any other.
    """
    rates = fixed.RATE_CARD if rates is None else rates

    def price(which: int) -> Column:
        if not rates:
            return F.lit(fixed.DEFAULT_RATE[which])
        pairs = [F.lit(x) for name, pair in rates.items() for x in (name, float(pair[which]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), model), F.lit(fixed.DEFAULT_RATE[which]))

    return price(0), price(1)


def price_calls(
    calls: DataFrame, rates: Mapping[str, tuple[float, float]] | None = None, column: str = "raw_cost_usd"
) -> DataFrame:
    """Unrounded cost of each call from its token counts."""
    per_input, per_output = rate_columns(F.col("model"), rates)
    return calls.withColumn(column, F.col("input_tokens") * per_input + F.col("output_tokens") * per_output)


def scenarios_with_detections(scenarios: DataFrame, detections: DataFrame) -> DataFrame:
    """Scenarios with their detection; those without one, or out of scope, are to be skipped."""
    joined = scenarios.join(detections.withColumn("has_detection", F.lit(True)), "transaction_id", "left")
    skip = F.col("id").isin(*fixed.OUT_OF_SCOPE_SCENARIOS) | F.col("has_detection").isNull()
    reason = (
        F.when(F.col("id").isin(*fixed.OUT_OF_SCOPE_SCENARIOS), "out of scope")
        .when(F.col("has_detection").isNull(), "no detection")
    )
    return joined.withColumns({"skipped": skip, "skip_reason": reason}).drop("has_detection")


def assemble_results(
    transactions: DataFrame, detections: DataFrame, explanations: DataFrame, evaluations: DataFrame
) -> DataFrame:
    """One wide row per transaction id with nullable nested stage results.

    All four sides are hashed on the same key, so the three joins share one partitioning of
    the growing left side.
    """

    def nested(df: DataFrame, name: str) -> DataFrame:
        return df.select("transaction_id", F.struct(*df.columns).alias(name))

    return (
        transactions.join(nested(detections, "detection"), "transaction_id", "left")
        .join(nested(explanations, "explanation"), "transaction_id", "left")
        .join(nested(evaluations, "evaluation"), "transaction_id", "left")
    )


def ungrounded_citations(citations: DataFrame, attributions: DataFrame) -> DataFrame:
    """Citations (transaction_id, array ``cited_features``) that no attribution row backs."""
    cited = citations.select("transaction_id", F.explode("cited_features").alias("feature_name"))
    return cited.join(attributions.select("transaction_id", "feature_name"), ["transaction_id", "feature_name"], "left_anti")
