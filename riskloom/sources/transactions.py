"""CSV sources for transactions and device identity, and lookups on them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import fixed_values as fixed
from riskloom import schemas
from riskloom.functions.text import null_tokens
from riskloom.operators.selection import smallest_by_hash


class SourceMissing(FileNotFoundError):
    """A required input does not exist."""


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a headed CSV, keeping the wanted columns that its header names.

    The reader takes the names from the header and the cells as text, so column order does
    not matter, nothing is scanned to guess types, and only selected columns are parsed.
    """
    try:
        df = spark.read.csv(path, header=True, escape='"', enforceSchema=False)
    except AnalysisException as error:
        if (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise SourceMissing(f"no input at {path}") from error
        raise
    return df.select(
        *[
            null_tokens(F.col(f.name), fixed.CSV_NULL_TOKENS).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name in df.columns
        ]
    )


def scan_transactions(
    spark: SparkSession, path: str, *, sample_n: int | None = None, seed: int = 42
) -> DataFrame:
    """Transactions from CSV; a seeded sample of ``sample_n`` rows if asked for."""
    df = _scan(spark, path, schemas.RAW_TRANSACTION)
    return df if sample_n is None else sample_rows(df, sample_n, seed=seed)


def scan_identity(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.RAW_IDENTITY)


def scan_identity_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The identity table, or None when there is none: device columns are then absent."""
    try:
        return scan_identity(spark, path)
    except SourceMissing:
        return None


def sample_rows(df: DataFrame, n: int, *, seed: int = 42, key: str = fixed.ROW_ID) -> DataFrame:
    """A repeatable sample of exactly ``n`` rows without replacement (all, if there are fewer)."""
    return smallest_by_hash(df, n, seed=seed, key=key)


def lookup_transaction(df: DataFrame, transaction_id: str | int) -> DataFrame:
    """The rows with one id. The literal takes the column's type, so the filter is pushed down."""
    kind = df.schema[fixed.ROW_ID].dataType
    return df.filter(F.col(fixed.ROW_ID) == F.lit(transaction_id).cast(kind))
