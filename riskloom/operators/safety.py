"""Screening of text that is about to enter a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.text import first_injection, first_injection_of


def scan_text(df: DataFrame, column: str, into: str = "injection_pattern") -> DataFrame:
    """The first injection pattern found in a text column, over the whole text."""
    return df.withColumn(into, first_injection(F.col(column)))


def scan_fields(df: DataFrame, fields: list[str] = fixed.PIPELINE_TEXT_FIELDS) -> DataFrame:
    """``injection`` = struct<source, pattern> of the first field with a hit, in field order."""
    present = [(n, F.col(n).cast("string")) for n in fields if n in df.columns]
    if not present:
        return df.withColumn("injection", F.lit(None).cast("struct<source:string,pattern:string>"))
    return df.withColumn("injection", first_injection_of(present))


def scan_raw_fields(df: DataFrame) -> DataFrame:
    """The same over raw records, the id first."""
    return scan_fields(df, fixed.RAW_TEXT_FIELDS)


def scan_attribution_values(df: DataFrame, column: str = "top_shap_features") -> DataFrame:
    """``unsafe_attribution``: a text-valued attribution carries an injection.

    Only the three user-controlled text features are looked at, and only text values.
    """
    unsafe = F.exists(
        column,
        lambda f: f["feature_name"].isin(*fixed.PIPELINE_TEXT_FIELDS)
        & f["feature_number"].isNull()
        & first_injection(f["feature_value"]).isNotNull(),
    )
    return df.withColumn("unsafe_attribution", F.coalesce(unsafe, F.lit(False)))
