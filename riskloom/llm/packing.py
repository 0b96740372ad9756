"""Best-fit packing by the sum-of-squares rule.

N(g) is the number of open sequences with g places left. A piece of length s goes to the gap g
(or to a new sequence) for which the sum of N(g)^2 becomes smallest; that is the gap with the
largest N(g) - N(g - s). Pieces come in descending length.

Pieces are dealt into groups of about ``group`` pieces, each packed in one task that holds
integers only. What a group leaves open (fewer than ``size`` kinds of gap, few of each) is packed
again with what other groups leave, as items of their filled length, until one group is left; so
the number of sequences hardly depends on how many groups there are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.encoders import default_path, encoder
from riskloom.llm.frames import small_batches, text_or_empty
from riskloom.session import settle

SIZE = 1024
GROUP = 2**16
END = 2


def _place(lengths: np.ndarray, size: int, best_fit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and place of each length, by descending length; the sequences still open."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # sequence numbers by gap
    counts = np.zeros(size + 1, dtype=np.int64)
    bins, places, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        there = counts[s:] > 0
        if best_fit:
            gap = s + int(there.argmax()) if there.any() else size
        else:
            gain = np.where(there, counts[s:] - counts[: size + 1 - s], np.iinfo(np.int64).min)
            gain[-1] = -counts[size - s]  # a new sequence: nothing is taken away
            gap = s + int(gain.argmax())
        if gap == size:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], places[i] = number, size - gap
        if gap > s:
            open_bins[gap - s].append(number)
            counts[gap - s] += 1
    return bins, places, np.array([b for gap in open_bins for b in gap], dtype=np.int64)


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to ``size``) the number of its sequence and its place there.

    Ties go to the smallest gap; a new sequence is one with gap ``size``. The rule keeps a few
    sequences of every gap open for pieces to come; as none come after the last, the pieces of
    those sequences are placed again, each in the smallest gap it fits in, if that saves any.
    """
    bins, places, still_open = _place(lengths, size, best_fit=False)
    loose = np.isin(bins, still_open)
    if loose.any():
        again, put, _ = _place(lengths[loose], size, best_fit=True)
        if again.max() + 1 < len(still_open):
            bins[loose], places[loose] = still_open[again], put
    return bins, places


def pieces(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document: its ids, then the id
    2, cut from the end into pieces of ``size``; only the first piece may be shorter."""
    path = path or default_path()

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["k"].array, batch["t"]):
                ids = np.append(encoder(path).ids(text), np.uint32(END)).astype("<u4")
                start, stop = 0, (len(ids) - 1) % size + 1
                for piece in range((len(ids) + size - 1) // size):
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop = stop, stop + size
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype(batch["k"].dtype))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), text_or_empty(docs, text).alias("t")).mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _packed_once(items: DataFrame, groups: int, size: int) -> DataFrame:
    """(n, length) to (n, bin, place): one level of packing, bins numbered by group."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "n"], ascending=[False, True])
        bins, places = sum_of_squares(frame["length"].to_numpy(), size)
        return pd.DataFrame({"n": frame["n"], "length": frame["length"], "bin": bins * groups + int(frame["g"].iloc[0]), "place": places})

    dealt = items.select("n", "length", F.pmod(F.xxhash64("n"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(pack, "n long, length long, bin long, place long")


def pack(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SIZE, group: int = GROUP,
) -> DataFrame:
    """Every piece of every document with its sequence_id and offset, in sequences of ``size``.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset; other columns of
    ``docs`` are left out. A null or empty text is one piece of one id. Full pieces are sequences
    of their own. Repeated rows are packed each. An empty table gives an empty table.
    """
    small_batches(docs)
    cut = settle(pieces(docs, path, key, text, size).withColumn("n", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == size).withColumns({"sequence_id": -F.col("n") - 1, "offset": F.lit(0).cast("long")})
    short = cut.where(F.col("length") < size)
    items, levels = short.select("n", "length"), []
    count = items.count()
    while count:
        groups = -(-count // group)
        level = settle(_packed_once(items, groups, size))
        levels.append(level)
        if groups == 1:
            break
        filled = level.groupBy("bin").agg(F.sum("length").alias("length")).select(F.col("bin").alias("n"), "length")
        items = settle(filled.where(F.col("length") < size))
        left = items.count()
        if 2 * left > count:  # nothing to gain from another level
            break
        count = left
    if not levels:
        return full.drop("n")
    placed = levels[0].select("n", F.col("bin").alias("b0"), F.col("place").alias("offset"))
    spread = [F.struct(F.lit(0).alias("level"), F.col("b0").alias("bin"))]
    for i, level in enumerate(levels[1:], 1):
        up = level.select(F.col("n").alias(f"b{i - 1}"), F.col("bin").alias(f"b{i}"), F.col("place").alias(f"p{i}"))
        placed = placed.join(up, f"b{i - 1}", "left").withColumn("offset", F.col("offset") + F.coalesce(f"p{i}", F.lit(0)))
        spread.append(F.when(F.col(f"b{i}").isNotNull(), F.struct(F.lit(i).alias("level"), F.col(f"b{i}").alias("bin"))))
    last = F.coalesce(*reversed(spread))
    placed = placed.select("n", "offset", (last["bin"] * len(levels) + last["level"]).alias("sequence_id"))
    result = short.join(placed, "n").select(*[c for c in cut.columns if c != "n"], "sequence_id", "offset")
    return full.select(result.columns).unionByName(result)
