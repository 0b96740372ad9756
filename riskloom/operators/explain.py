"""Prompts for explanations and judging, and explanation records from recorded responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import fixed_values as fixed
from riskloom import schemas
from riskloom.functions.numbers import fixed_digits, percent_text, round_even
from riskloom.functions.risk import missing_from, ranked_attributions, timed_out
from riskloom.functions.text import fill_template, quoted_list, title_bool
from riskloom.operators.join import price_calls


def _attribution_lines(features: Column) -> Column:
    line = lambda f: F.concat(
        F.lit("  - "), f["feature_name"], F.lit(": shap_value="), fixed_digits(f["shap_value"], 4),
        F.lit(", value="), F.coalesce(f["feature_value"], F.lit("None")),
    )
    return F.array_join(F.transform(features, line), "\n")


def _names(features: Column) -> Column:
    return F.transform(features, lambda f: f["feature_name"])


def _only_if_low(text: str) -> Column:
    return F.when(F.col("confidence_tier") == "low", text).otherwise("")


def analyst_prompt(df: DataFrame) -> DataFrame:
    """``system_prompt`` and ``user_prompt`` with every attribution and its value."""
    features, p = F.col("top_shap_features"), F.col("fraud_probability")
    system = fill_template(
        fixed.ANALYST_SYSTEM, probability=percent_text(p, 1), low_confidence=_only_if_low(fixed.ANALYST_LOW_CONFIDENCE)
    )
    user = fill_template(
        fixed.ANALYST_USER,
        transaction_id=F.col("transaction_id"), probability=percent_text(p, 1),
        predicted=title_bool(F.col("is_fraud_predicted")), tier=F.col("confidence_tier"),
        n=F.size(features).cast("string"), attributions=_attribution_lines(features),
    )
    return df.withColumns({"system_prompt": system, "user_prompt": user})


def customer_prompt(df: DataFrame) -> DataFrame:
    """``system_prompt`` and ``user_prompt`` with the three strongest names and no number."""
    top = ranked_attributions(F.col("top_shap_features"), fixed.CUSTOMER_TOP_K, ties="early")
    names = F.array_join(F.transform(top, lambda f: F.concat(F.lit("  - "), f["feature_name"])), "\n")
    status = F.when(F.col("is_fraud_predicted"), fixed.STATUS_FLAGGED).otherwise(fixed.STATUS_NORMAL)
    return df.withColumns(
        {
            "system_prompt": fill_template(
                fixed.CUSTOMER_SYSTEM, low_confidence=_only_if_low(fixed.CUSTOMER_LOW_CONFIDENCE)
            ),
            "user_prompt": fill_template(
                fixed.CUSTOMER_USER, transaction_id=F.col("transaction_id"), status=status, names=names
            ),
        }
    )


def prompt_for_audience(df: DataFrame, audience: str) -> DataFrame:
    return analyst_prompt(df) if audience == "analyst" else customer_prompt(df)


def judge_prompt(df: DataFrame) -> DataFrame:
    """Rubric prompt over explanations joined with their detections."""
    features, analyst = F.col("top_shap_features"), F.col("target_audience") == "analyst"
    system = fill_template(
        fixed.JUDGE_SYSTEM,
        audience=F.col("target_audience"),
        criteria=F.when(analyst, fixed.JUDGE_ANALYST_CRITERIA).otherwise(fixed.JUDGE_CUSTOMER_CRITERIA),
        uncertainty=F.when(F.col("uncertainty_flag"), fixed.JUDGE_UNCERTAINTY).otherwise(""),
    )
    user = fill_template(
        fixed.JUDGE_USER,
        transaction_id=F.col("transaction_id"), audience=F.col("target_audience"),
        probability=percent_text(F.col("fraud_probability"), 1), predicted=title_bool(F.col("is_fraud_predicted")),
        tier=F.col("confidence_tier"), attributions=_attribution_lines(features), names=quoted_list(_names(features)),
        text=F.col("explanation_text"), cited=quoted_list(F.col("cited_features")),
        uncited=quoted_list(F.col("uncited_features")), hallucinated=quoted_list(F.col("hallucinated_features")),
        flag=title_bool(F.col("uncertainty_flag")),
        disclosure=F.coalesce(F.col("uncertainty_disclosure"), F.lit("None")),
    )
    return df.withColumns({"system_prompt": system, "user_prompt": user})


def parse_responses(df: DataFrame, column: str = "response_text") -> DataFrame:
    """The structured fields of recorded responses; ``parsed`` is false for malformed ones."""
    corrupt = "__corrupt"
    schema = T.StructType([*schemas.RESPONSE.fields, T.StructField(corrupt, T.StringType())])
    r = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    opened = df.withColumn("__r", r)
    ok = (
        F.col("__r").isNotNull()
        & F.col(f"__r.{corrupt}").isNull()
        & F.col("__r.explanation_text").isNotNull()
        & F.col("__r.cited_features").isNotNull()
    )
    opened = opened.withColumn("parsed", ok)
    fields = {n: F.when(F.col("parsed"), F.col(f"__r.{n}")) for n in schemas.RESPONSE.fieldNames()}
    return opened.withColumns(fields).drop("__r")


def ground_citations(df: DataFrame) -> DataFrame:
    """``hallucinated_features``: cited but not attributed; ``uncited_features``: the reverse.

    Both keep order and repeats.
    """
    cited, known = F.col("cited_features"), _names(F.col("top_shap_features"))
    return df.withColumns(
        {"hallucinated_features": missing_from(cited, known), "uncited_features": missing_from(known, cited)}
    )


def explanation_outcome(df: DataFrame) -> DataFrame:
    """How each explanation call ended, from detections joined with parsed responses.

    ``outcome``: ``no_attributions`` (no call is made), ``timeout``, ``failed`` (the call
    broke otherwise or its response is malformed), ``ungrounded``, or ``ok``.
    """
    broke = F.col("message").isNotNull() | ~F.coalesce(F.col("parsed"), F.lit(False))
    slow = timed_out(F.col("duration_seconds"), F.col("message"), fixed.EXPLANATION_LIMIT_S)
    outcome = (
        F.when(F.coalesce(F.size("top_shap_features"), F.lit(0)) <= 0, "no_attributions")
        .when(broke & slow, "timeout")
        .when(broke, "failed")
        .when(F.size("hallucinated_features") > 0, "ungrounded")
        .otherwise("ok")
    )
    return df.withColumn("outcome", outcome)


def explanation_records(joined: DataFrame, audience: str | Column, *keep: str) -> DataFrame:
    """Explanation records from rows that hold a detection and its recorded response.

    The response is response_text, model, input_tokens, output_tokens, duration_seconds and
    message. Degraded records (no attributions, timeout) have empty text and no cost.
    ``outcome`` says which rows did not become a usable record. Row by row, no shuffle.
    """
    calls = price_calls(parse_responses(joined))
    ended = ground_citations(calls).transform(explanation_outcome)
    answered = F.col("outcome").isin("ok", "ungrounded")
    none = F.array().cast("array<string>")
    target = F.lit(audience) if isinstance(audience, str) else audience
    return ended.withColumn("target_audience", target).select(
        "transaction_id",
        "target_audience",
        "fraud_probability",
        "is_fraud_predicted",
        F.when(answered, F.col("explanation_text")).otherwise("").alias("explanation_text"),
        F.when(answered, F.col("cited_features")).otherwise(none).alias("cited_features"),
        F.when(answered, F.col("uncited_features")).otherwise(none).alias("uncited_features"),
        F.when(answered, F.col("hallucinated_features")).otherwise(none).alias("hallucinated_features"),
        (F.col("confidence_tier") == "low").alias("uncertainty_flag"),
        F.when(answered, F.col("uncertainty_disclosure")).alias("uncertainty_disclosure"),
        answered.alias("explanation_generated"),
        F.when(F.col("outcome") == "no_attributions", fixed.WARNING_NO_ATTRIBUTIONS)
        .when(F.col("outcome") == "timeout", fixed.WARNING_TIMEOUT).alias("warning"),
        F.when(answered, F.col("raw_cost_usd")).otherwise(0.0).alias("token_cost_usd"),
        F.when(F.col("outcome") == "no_attributions", 0.0)
        .otherwise(round_even(F.col("duration_seconds"), 3)).alias("generation_latency_seconds"),
        "outcome",
        *keep,
    )


def build_explanations(detections: DataFrame, responses: DataFrame, audience: str | Column) -> DataFrame:
    """Explanation records of detections and their recorded responses, joined on the id."""
    return explanation_records(detections.join(responses, "transaction_id", "left"), audience)


def degraded_explanations(explanations: DataFrame) -> DataFrame:
    return explanations.filter(F.col("warning").isNotNull())


def generate_text(
    prompts: DataFrame, generator: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Run a user-supplied generator or judge over a prompt table.

    The callable gets Arrow batches of the prompt columns and returns rows of ``schema``;
    retries and connections are its own business. Callers filter out rows that need no call
    before this point: a Python stage runs for every row it is given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield generator(batch)

    return prompts.mapInPandas(run, schema)


def check_phrases(df: DataFrame) -> DataFrame:
    """Required phrases that are absent and forbidden phrases that are present.

    Takes ``explanation_text`` and the phrase arrays ``explanation_must_contain`` and
    ``explanation_must_not_contain`` (null means no rule).
    """
    text = F.col("explanation_text")
    none = F.array().cast("array<string>")
    absent = F.filter("explanation_must_contain", lambda p: ~F.contains(text, p))
    present = F.filter("explanation_must_not_contain", lambda p: F.contains(text, p))
    return df.withColumns(
        {"absent_phrases": F.coalesce(absent, none), "forbidden_phrases": F.coalesce(present, none)}
    ).withColumn("phrases_ok", (F.size("absent_phrases") == 0) & (F.size("forbidden_phrases") == 0))
