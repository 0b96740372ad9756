"""Cost accounting over the log of model calls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import exact_sum, round_even
from riskloom.functions.risk import routing_tier
from riskloom.operators.join import price_calls

_DIGITS = 6


def _spend(c: Column | None = None) -> Column:
    return exact_sum(F.col("cost_usd") if c is None else c)


def call_records(
    calls: DataFrame,
    *,
    rates: Mapping[str, tuple[float, float]] | None = None,
    budget: float = fixed.CALL_BUDGET_USD,
) -> DataFrame:
    """The log record of each call; the budget is tested on the unrounded cost."""
    priced = price_calls(calls, rates)
    absent = {n: F.lit(None).cast(t) for n, t in (("confidence", "double"), ("passed", "boolean")) if n not in calls.columns}
    out = priced.withColumns(
        {
            **absent,
            "tier": routing_tier(F.col("model")),
            "cost_usd": round_even(F.col("raw_cost_usd"), 8),
            "duration_seconds": round_even(F.col("duration_seconds"), 3),
            "budget_breached": F.col("raw_cost_usd") > F.lit(budget),
        }
    )
    extra = [c for c in ("call_id",) if c in calls.columns]
    return out.select(
        *extra, "timestamp", "transaction_id", "phase", "agent_name", "model", "tier", "input_tokens", "output_tokens",
        "cost_usd", "duration_seconds", "confidence", "passed", "budget_breached",
    )


def in_phase(records: DataFrame, phase: str | None) -> DataFrame:
    """Only one phase if one is named; a plain equality, so it reaches the scan."""
    return records if phase is None else records.filter(F.col("phase") == phase)


def budget_breaches(records: DataFrame) -> DataFrame:
    return records.filter(F.col("budget_breached"))


def per_transaction(records: DataFrame) -> DataFrame:
    """Calls, cost and breaches by transaction and by the labels of the report.

    The first step of the totals and of the report: after it no later step sees more than one
    row per (transaction, labels), so distinct transactions are counted on far fewer rows.
    """
    return records.groupBy(
        "transaction_id",
        F.coalesce("phase", F.lit("unknown")).alias("phase"),
        "agent_name",
        F.coalesce("tier", F.lit("unknown")).alias("tier"),
    ).agg(
        F.count("*").alias("calls"),
        _spend().alias("cost"),
        F.count_if("budget_breached").alias("breaches"),
    )


def cost_totals(records: DataFrame) -> DataFrame:
    """Spend, calls, transactions, average and projection per hundred transactions."""
    by_transaction = records.groupBy("transaction_id").agg(
        F.count("*").alias("calls"), _spend().alias("cost"), F.count_if("budget_breached").alias("breaches")
    )
    total = by_transaction.agg(
        _spend(F.col("cost")).alias("cost"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.count("transaction_id").alias("transactions"),
        F.coalesce(F.sum("breaches"), F.lit(0)).alias("budget_breaches"),
    )
    average = F.coalesce(F.try_divide(F.col("cost"), F.col("transactions")), F.lit(0.0))
    return total.select(
        round_even(F.coalesce("cost", F.lit(0.0)), _DIGITS).alias("total_cost"),
        "calls",
        "transactions",
        round_even(average, _DIGITS).alias("average_per_transaction"),
        round_even(average * 100, 4).alias("projected_per_100"),
        "budget_breaches",
    )


def cost_by_phase(records: DataFrame) -> DataFrame:
    """Spend per phase, sorted; calls without a phase are listed as unknown."""
    sums = records.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(_spend().alias("cost"))
    return sums.select("phase", round_even(F.col("cost"), _DIGITS).alias("cost")).orderBy("phase")


def cost_by_agent(records: DataFrame) -> DataFrame:
    sums = records.groupBy("agent_name").agg(F.count("*").alias("calls"), _spend().alias("cost"))
    return sums.select(
        "agent_name",
        "calls",
        round_even(F.col("cost"), _DIGITS).alias("cost"),
        round_even(F.col("cost") / F.col("calls"), 8).alias("average_per_call"),
    ).orderBy("agent_name")


def tier_mix(records: DataFrame) -> DataFrame:
    """Share of cheap calls; all others count as strong."""
    cheap = F.coalesce(F.try_divide(F.count_if(F.col("tier") == "cheap") * F.lit(100.0), F.count("*")), F.lit(0.0))
    return records.agg(cheap.alias("cheap")).select(
        round_even(F.col("cheap"), _DIGITS).alias("cheap_percent"),
        round_even(100 - F.col("cheap"), _DIGITS).alias("strong_percent"),
    )


def cost_report(records: DataFrame, phase: str | None = None) -> DataFrame:
    """Totals, phases, agents and tiers in one scan.

    ``section`` says which; ``name`` is the label within it, with its averages, its projection
    for a hundred transactions and its share of all calls. The grouping sets run over the
    per-transaction sums, not over the log; the share is taken over the report's few rows.
    """
    sums = per_transaction(in_phase(records, phase))
    sets = sums.groupingSets([[], ["phase"], ["agent_name"], ["tier"]], "phase", "agent_name", "tier").agg(
        F.grouping_id("phase", "agent_name", "tier").alias("g"),
        F.sum("calls").alias("calls"),
        F.countDistinct("transaction_id").alias("transactions"),
        _spend(F.col("cost")).alias("cost"),
        F.sum("breaches").alias("budget_breaches"),
    )
    section = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "phase").when(F.col("g") == 5, "agent").otherwise("tier")
    name = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, F.col("phase")).when(F.col("g") == 5, F.col("agent_name"))
    each = F.try_divide(F.col("cost"), F.col("transactions"))
    # One row for each label: few enough to be one array next to their total.
    together = sets.agg(F.max(F.when(F.col("g") == 7, F.col("calls"))).alias("all"), F.collect_list(F.struct(*sets.columns)).alias("r"))
    return together.select("all", F.inline("r")).select(
        section.alias("section"),
        name.otherwise(F.col("tier")).alias("name"),
        "calls",
        "transactions",
        round_even(F.col("cost"), _DIGITS).alias("cost"),
        round_even(F.col("cost") / F.col("calls"), 8).alias("average_per_call"),
        round_even(each, _DIGITS).alias("average_per_transaction"),
        round_even(each * 100, 4).alias("projected_per_100"),
        round_even(F.col("calls") * F.lit(100.0) / F.col("all"), _DIGITS).alias("percent_of_calls"),
        "budget_breaches",
    )


def breaches_by_agent(records: DataFrame) -> DataFrame:
    """Calls over budget of each agent."""
    return records.groupBy("agent_name").agg(F.count_if("budget_breached").alias("budget_breaches"))


def routing_by_agent_tier(records: DataFrame) -> DataFrame:
    """Calls of each agent to each tier."""
    return records.groupBy("agent_name", "tier").agg(F.count("*").alias("calls"))


def budget_per_transaction(records: DataFrame) -> DataFrame:
    """Spend of each transaction per agent and in all, against the three limits."""

    def of(agent: str) -> Column:
        return F.coalesce(_spend(F.when(F.col("agent_name") == agent, F.col("cost_usd"))), F.lit(0.0))

    sums = records.groupBy("transaction_id").agg(
        of("ExplanationAgent").alias("explanation_cost"), of("EvalAgent").alias("evaluation_cost"), _spend().alias("total_cost")
    )
    costs = ["explanation_cost", "evaluation_cost", "total_cost"]
    return sums.select(
        "transaction_id",
        *[round_even(F.col(c), _DIGITS).alias(c) for c in costs],
        (F.col("explanation_cost") > fixed.EXPLANATION_BUDGET_USD).alias("explanation_over"),
        (F.col("evaluation_cost") > fixed.EVALUATION_BUDGET_USD).alias("evaluation_over"),
        (F.col("total_cost") > fixed.CALL_BUDGET_USD).alias("total_over"),
    )
