"""From raw tables to the cleaned, feature-engineered transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.clean import clean, engineer
from riskloom.operators.join import join_identity
from riskloom.sources.transactions import sample_rows, scan_identity_if_present, scan_transactions


def clean_tables(
    transactions: DataFrame,
    identity: DataFrame | None = None,
    *,
    sample_n: int | None = None,
    seed: int = 42,
    features: bool = True,
) -> DataFrame:
    """Sample, join with identity, clean, and add the engineered columns.

    One lazy plan; the product and amount filters touch only the left side of the left join,
    so the optimizer moves them below it.
    """
    if sample_n is not None:
        transactions = sample_rows(transactions, sample_n, seed=seed)
    cleaned = join_identity(transactions, identity).transform(clean)
    return cleaned.transform(engineer) if features else cleaned


def load_clean(
    spark: SparkSession,
    folder: str,
    *,
    sample_n: int | None = None,
    seed: int = 42,
    with_identity: bool = True,
    features: bool = True,
) -> DataFrame:
    """The same from the two CSV files in a folder; a missing identity file is no error."""
    transactions = scan_transactions(spark, f"{folder}/train_transaction.csv")
    identity = scan_identity_if_present(spark, f"{folder}/train_identity.csv") if with_identity else None
    return clean_tables(transactions, identity, sample_n=sample_n, seed=seed, features=features)
