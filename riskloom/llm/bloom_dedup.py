"""Exact deduplication: a two-pass Bloom filter, so that only possibly repeated rows shuffle.

The first pass counts how often each slot of each hash function is hit and keeps the slots hit
twice or more as bitmaps. In the second pass a row whose slots are all in the bitmaps may have
an equal; such rows are written once, grouped by the SHA-256 of their text and joined back.
All other rows have no equal and pass straight through, without a shuffle.

The bitmaps are broadcast: ``functions`` times ``most_bits`` / 8 bytes at most, whatever the
input. Past about ``most_bits`` / 4 rows more rows are taken for possibly repeated and shuffle;
the result is the same. Groups are aggregated with combining on the map side; groups that hold a
thousandth of all rows or more are joined back by broadcast, the others by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import join_groups, packed, text_or_empty, unpacked
from riskloom.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
BITMAP = 32768


def _slots(sha: Column, functions: int, bits: int) -> list[Column]:
    """One slot per hash function; each function has a range of its own."""
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) + F.lit(i * bits) for i in range(functions)]


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def repeated_slots(shas: DataFrame, functions: int, bits: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the slots that two or more rows of ``shas`` (sha) hit."""
    hits = shas.select(F.explode(F.array(*_slots(F.col("sha"), functions, bits))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )


def possible_members(rows: DataFrame, members: DataFrame, on: list[str], most_bits: int = 2**29) -> DataFrame:
    """``rows`` with ``maybe``: false only for rows that have no equal in ``members`` on ``on``.

    One bitmap of 16 bits for each member, at most ``most_bits`` / 8 bytes, is broadcast; so a
    join that follows shuffles the rows that may match, and the others stay where they are.
    """
    count, bits = members.count(), BITMAP
    while bits < min(16 * count, most_bits):
        bits *= 2
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    hit = members.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    joined = rows.withColumn("slot", slot).join(F.broadcast(settle(hit)), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    return joined.withColumn("maybe", _has_bit(F.col("bits"), F.bitmap_bit_position("slot"))).select(*rows.columns, "maybe")


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", functions: int = 2, most_bits: int = 2**29,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; no row is dropped.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest key stays. A null text counts as empty. A null key is smaller than any other; where
    rows tie on the largest key (repeated rows) exactly one of them is kept. Columns of ``docs``
    named like a result are replaced by it. An empty table gives an empty table.
    """
    count = docs.count()
    bits = BITMAP
    while bits < min(16 * count, most_bits):
        bits *= 2
    folded = F.translate(text_or_empty(docs, text), UPPER, LOWER)
    rows = packed(docs, k=docs[key], sha=F.sha2(folded.cast("binary"), 256))
    filters = settle(repeated_slots(rows.select("sha"), functions, bits))
    maybe = F.lit(True)
    for i, slot in enumerate(_slots(F.col("sha"), functions, bits)):
        side = filters.select(F.col("bucket").alias(f"b{i}"), F.col("bits").alias(f"bits{i}"))
        # at most bits / 8 bytes for each function
        rows = rows.withColumn(f"s{i}", slot).join(F.broadcast(side), F.bitmap_bucket_number(f"s{i}") == F.col(f"b{i}"), "left")
        maybe = maybe & _has_bit(F.col(f"bits{i}"), F.bitmap_bit_position(f"s{i}"))
    rows = rows.select("row", "k", "sha", maybe.alias("maybe"))
    alone = rows.where(~F.col("maybe")).select(
        "row", F.col("k").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    several = settle(rows.where("maybe").select("row", "k", "sha", F.monotonically_increasing_id().alias("n")))
    best = settle(several.groupBy("sha").agg(F.max(F.struct("k", "n")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    together = join_groups(several, best, "sha", "group_size", count).select(
        "row", F.col("best.k").alias("keep_id"), "group_size", (F.col("n") == F.col("best.n")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return unpacked(alone.unionByName(together), docs.columns, *RESULTS)
