"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import settle


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, next to the named columns.

    Operators work on such frames, so that no column of the caller can clash with their own.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if docs.columns else F.struct(F.lit(None).alias("_"))
    return docs.select(whole.alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """The caller's columns again, then the results; a result replaces a column of its name."""
    taken = {r.lower() for r in results}
    own = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*own, *results)


def text_or_empty(docs: DataFrame, name: str = "text") -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a place in a file, else ``docs`` written once and read.

    Places (file and row number) name rows across several scans, also rows that are repeated, and
    stay the same when a task is run again.
    """
    try:
        docs.select(place(docs))
        return docs
    except AnalysisException:
        return settle(docs)


def place(docs: DataFrame) -> Column:
    """The place of each row of a located frame: a struct of two longs."""
    file = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(file.getField("file_path"), file.getField("file_size")).alias("file"), file.getField("row_index").alias("row"))

#: Groups that hold at least this share of all rows are joined by broadcast: 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to their group (one row per ``key`` in ``groups``, with its ``size``).

    No key of the shuffled join holds more than a thousandth of ``total`` rows: the groups that do
    are a thousand at most and are broadcast, so a hot group stays spread as its rows are.
    """
    hot = F.col(size) >= max(2.0, total * HOT_SHARE)
    large = F.broadcast(groups.where(hot))
    rest = rows.join(large.select(key), key, "left_anti").join(groups.where(~hot), key)
    return rows.join(large, key).unionByName(rest)

#: Rows that Spark sends to a Python worker at once, where the session has not chosen a number.
BATCH_ROWS = 500
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(docs: DataFrame) -> None:
    """Bounds what a Python worker holds of whole texts; a session's own setting is left alone."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(BATCH_ROWS))
