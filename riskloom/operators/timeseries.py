"""Counters, histograms, rates and limits over the call log and the request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import at_most_counts, exact_sum, round_even

_LABELS = {b: f"{b:g}" for b in fixed.COST_BUCKETS + fixed.LATENCY_BUCKETS}


def token_rows(calls: DataFrame, *keep: str) -> DataFrame:
    """Token counts in long form: one row per call and direction."""
    return calls.unpivot(
        list(keep), [F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output")], "token_type", "tokens"
    )


def token_counters(calls: DataFrame) -> DataFrame:
    """Tokens by agent, model and direction.

    Both sums are taken in one aggregate and turned into rows afterwards, so the log is not
    doubled before the shuffle.
    """
    sums = calls.groupBy("agent_name", "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    return token_rows(sums, "agent_name", "model")


def histogram(
    df: DataFrame, value: str, bounds: Sequence[float], *by: Column | str, total: Column | None = None
) -> DataFrame:
    """Per group: ``counts`` (cumulative, one per bound, then all), ``total`` and ``count``."""
    return df.groupBy(*by).agg(
        F.array(*at_most_counts(F.col(value), bounds)).alias("counts"),
        (F.sum(value) if total is None else total).alias("total"),
        F.count(value).alias("count"),
    )


def histogram_rows(hist: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """One row per bucket with its upper bound as text, the last one ``+Inf``."""
    labels = F.array(*[F.lit(_LABELS.get(b, f"{b:g}")) for b in bounds], F.lit("+Inf"))
    keep = [c for c in hist.columns if c != "counts"]
    return hist.select(*keep, F.inline(F.arrays_zip(labels.alias("le"), F.col("counts").alias("at_most"))))


def cost_histogram(priced: DataFrame) -> DataFrame:
    hist = histogram(priced, "raw_cost_usd", fixed.COST_BUCKETS, total=exact_sum(F.col("raw_cost_usd")))
    return histogram_rows(hist.withColumn("total", round_even(F.col("total"), 6)), fixed.COST_BUCKETS)


def latency_histogram(requests: DataFrame) -> DataFrame:
    hist = histogram(requests, "duration_s", fixed.LATENCY_BUCKETS, "endpoint")
    return histogram_rows(hist.withColumn("total", round_even(F.col("total"), 4)), fixed.LATENCY_BUCKETS)


def quantile_from(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """Quantile by linear interpolation inside the bucket in which its rank falls.

    Beyond the last finite bound that bound is the answer; the first bucket starts at zero.
    """
    limits = F.array(*[F.lit(float(b)) for b in bounds])
    rank = F.lit(q) * F.element_at(counts, -1)
    at = F.size(F.filter(counts, lambda c: c < rank))
    before = F.when(at > 0, F.get(counts, at - 1)).otherwise(0)
    low = F.when(at > 0, F.get(limits, at - 1)).otherwise(F.lit(0.0))
    inside = low + (F.get(limits, at) - low) * F.try_divide(rank - before, F.get(counts, at) - before)
    return F.when(F.element_at(counts, -1) == 0, None).when(at >= len(bounds), float(bounds[-1])).otherwise(inside)


def histogram_quantiles(hist: DataFrame, bounds: Sequence[float], quantiles: Sequence[float]) -> DataFrame:
    named = {f"p{round(q * 100)}": q for q in quantiles}
    keep = [c for c in hist.columns if c not in ("counts", "total", "count")]
    raw = hist.select(*keep, *[quantile_from(F.col("counts"), bounds, q).alias(n) for n, q in named.items()])
    return raw.select(*keep, *[round_even(F.col(n), 6).alias(n) for n in named])


def request_counters(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint", "method", "status_code").agg(F.count("*").alias("requests"))


def time_window(ts: str, length: str, slide: str | None = None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def windowed_rate(
    df: DataFrame, ts: str, amount: Column, seconds: int, *by: str, slide_seconds: int | None = None
) -> DataFrame:
    """Per-second rate of ``amount`` in windows of a fixed length, by label."""
    slide = f"{slide_seconds} seconds" if slide_seconds else None
    w = time_window(ts, f"{seconds} seconds", slide).alias("w")
    return (
        df.groupBy(w, *by)
        .agg((F.sum(amount) / F.lit(float(seconds))).alias("rate"))
        .select(F.col("w.start").alias("window_start"), *by, round_even(F.col("rate"), 6).alias("rate"))
    )


def token_rate(calls: DataFrame, seconds: int = 300, slide_seconds: int | None = None) -> DataFrame:
    both = F.col("input_tokens") + F.col("output_tokens")
    return windowed_rate(calls, "timestamp", both, seconds, "agent_name", slide_seconds=slide_seconds)


def request_rate(requests: DataFrame, seconds: int = 300, slide_seconds: int | None = None) -> DataFrame:
    return windowed_rate(requests, "ts", F.lit(1), seconds, slide_seconds=slide_seconds)


def windowed_cost_quantiles(priced: DataFrame, seconds: int = 300) -> DataFrame:
    w = time_window("timestamp", f"{seconds} seconds").alias("w")
    hist = histogram(priced, "raw_cost_usd", fixed.COST_BUCKETS, w)
    named = histogram_quantiles(hist, fixed.COST_BUCKETS, [0.50, 0.95, 0.99])
    return named.select(F.col("w.start").alias("window_start"), "p50", "p95", "p99")


def stat_panels(records: DataFrame) -> DataFrame:
    """Total cost, breaches and calls by tier as named single numbers."""
    one = records.agg(
        F.coalesce(exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost"),
        F.count_if("budget_breached").cast("double").alias("budget_breaches"),
        F.count_if(F.col("tier") == "cheap").cast("double").alias("calls_cheap"),
        F.count_if(F.col("tier") == "strong").cast("double").alias("calls_strong"),
    )
    rounded = one.withColumn("total_cost", round_even(F.col("total_cost"), 6))
    return rounded.unpivot([], one.columns, "panel", "value")


def rate_limit(
    requests: DataFrame, *, limit: int = fixed.REQUESTS_PER_MINUTE, unit: str = "minute", order: str = "request_id"
) -> DataFrame:
    """Flag requests beyond ``limit`` per client, endpoint and calendar unit with status 429.

    Only the analysing endpoints are limited, each on its own, and a request refused for its key
    (status 401) neither counts nor is limited. The first ``limit`` requests of each (client,
    endpoint, unit) are found by a ranked filter, which Spark also applies before the shuffle, so
    a client with most of the traffic sends only ``limit`` rows per task. Its last admitted
    request is then compared with every row. All rows stay; ``order`` makes the sequence within
    one instant definite and has to be unique.
    """
    counts = F.col("endpoint").isin(*fixed.LIMITED_ENDPOINTS) & ~F.coalesce(F.col("status_code") == 401, F.lit(False))
    keyed = requests.withColumns({"bucket": F.date_trunc(unit, "ts"), "counts": F.coalesce(counts, F.lit(False))})
    key = ["client", "endpoint", "bucket"]
    w = Window.partitionBy(*key).orderBy("ts", order)
    last = (
        keyed.filter("counts").select(*key, "ts", order)
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= limit)
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.max(F.struct("ts", order)).alias("last"))
        .filter(F.col("n") == limit)
        .select(*key, "last")
    )
    over = F.col("counts") & F.coalesce(F.struct("ts", order) > F.col("last"), F.lit(False))
    return (
        keyed.join(last, key, "left")
        .withColumn("limited", over)
        .withColumn("status_code", F.when(F.col("limited"), 429).otherwise(F.col("status_code")))
        .drop("last", "bucket", "counts")
    )


def windowed_latency_p95(calls: DataFrame, seconds: int = 300) -> DataFrame:
    """95th percentile of call durations in each window, from the latency buckets."""
    w = time_window("timestamp", f"{seconds} seconds").alias("w")
    hist = histogram(calls, "duration_seconds", fixed.LATENCY_BUCKETS, w)
    return histogram_quantiles(hist, fixed.LATENCY_BUCKETS, [0.95]).select(F.col("w.start").alias("window_start"), "p95")
