"""Scalar cleaning and feature engineering on the transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import is_missing, number_of
from riskloom.functions.text import free_text, redact, strip, vocabulary

_ENUMS = {
    "card4": fixed.CARD_NETWORKS,
    "card6": fixed.CARD_KINDS,
    "DeviceType": fixed.DEVICE_TYPES,
}


def _have(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def id_to_string(df: DataFrame) -> DataFrame:
    return df.withColumn(fixed.ROW_ID, F.col(fixed.ROW_ID).cast("string"))


def clean_enums(df: DataFrame) -> DataFrame:
    """Lower-case and strip card network, card kind and device type; null outside the vocabulary."""
    return df.withColumns(
        {n: vocabulary(strip(F.lower(F.col(n))), allowed) for n, allowed in _ENUMS.items() if n in df.columns}
    )


def filter_product(df: DataFrame) -> DataFrame:
    """Upper-case and strip the product code; rows outside the vocabulary, or without one, go."""
    if "ProductCD" not in df.columns:
        return df
    code = strip(F.upper(F.col("ProductCD")))
    return df.withColumn("ProductCD", code).filter(F.col("ProductCD").isin(*fixed.PRODUCT_CODES))


def filter_amount(df: DataFrame) -> DataFrame:
    """Drop non-positive amounts; an unknown amount stays."""
    if fixed.AMOUNT not in df.columns:
        return df
    amount = F.col(fixed.AMOUNT)
    return df.filter(~F.coalesce(amount <= 0, F.lit(False)))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """card1 and addr1 as numbers; NaN and text that is no number become null."""
    return df.withColumns({n: number_of(strip(F.col(n).cast("string"))) for n in _have(df, ["card1", "addr1"])})


def clean_text(df: DataFrame) -> DataFrame:
    return df.withColumns({n: free_text(F.col(n)) for n in _have(df, fixed.FREE_TEXT)})


def amount_log(df: DataFrame) -> DataFrame:
    if fixed.AMOUNT not in df.columns:
        return df
    return df.withColumn("TransactionAmt_log", F.log1p(fixed.AMOUNT))


def email_match(df: DataFrame) -> DataFrame:
    """1 iff both domains are known and equal."""
    if len(_have(df, ["P_emaildomain", "R_emaildomain"])) < 2:
        return df
    same = F.coalesce(F.col("P_emaildomain") == F.col("R_emaildomain"), F.lit(False))
    return df.withColumn("email_domain_match", same.cast("int"))


def missing_count(df: DataFrame) -> DataFrame:
    """How many of the key fields the table has are null or NaN."""
    present = _have(df, fixed.MISSING_COUNT_FIELDS)
    if not present:
        return df
    total = sum((is_missing(df, n).cast("int") for n in present[1:]), is_missing(df, present[0]).cast("int"))
    return df.withColumn("missing_count", total)


def engineer(df: DataFrame) -> DataFrame:
    return df.transform(amount_log).transform(email_match).transform(missing_count)


def clean(df: DataFrame) -> DataFrame:
    """All cleaning steps in their fixed order; projections and filters only, so no shuffle."""
    return (
        df.transform(id_to_string)
        .transform(clean_enums)
        .transform(filter_product)
        .transform(filter_amount)
        .transform(coerce_numeric)
        .transform(clean_text)
    )


def redact_secrets(df: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    return df.withColumn(column, redact(F.col(column), secrets))
