"""Token counts: huge documents are encoded as overlapping chunks and spliced.

Chunk c of a huge document owns ``chunk`` characters and is encoded with ``overlap`` characters
of its right neighbour. Within the overlap both encodings have their token starts; the seam is
the first common start where a blank, tab or newline follows a character that is no white space.
Such a place is stable: no alternative of the splitting pattern (nor a special token) reaches
over it, so tokens to its left do not depend on what follows it and tokens to its right not on
what precedes it. Documents with a seam that has no such place are tried again with an
overlap eight times as wide, at last as one chunk; others are done after the first round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.encoders import default_path, encoder
from riskloom.llm.frames import packed, small_batches, text_or_empty, unpacked
from riskloom.session import settle

CHUNK = 2**15
OVERLAP = 2**9
RESULTS = ("n_bytes", "n_tokens", "over_limit")
_PLACES = "array<struct<at: long, tokens: long>>"


def stable_starts(text: str, low: int, high: int, ends: np.ndarray) -> list[tuple[int, int]]:
    """Places in text[low:high] that are stable and start a token: (place, tokens before it).

    ``ends``: the bytes of the text up to the end of each token.
    """
    found = []
    at, size = low, len(text[:low].encode("utf-8", "surrogatepass"))
    for place in range(max(1, low), min(high, len(text))):
        if text[place] in " \t\n" and not text[place - 1].isspace():
            size += len(text[at:place].encode("utf-8", "surrogatepass"))
            at = place
            index = int(np.searchsorted(ends, size))
            if index < len(ends) and ends[index] == size:
                found.append((place, index + 1))
    return found


def _rounds(huge: DataFrame, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Counts (n, n_tokens) of what could be spliced, and the documents that could not."""
    last = F.ceil(F.col("size") / chunk) - 1
    pieces = huge.select("n", "t", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("c")).select(
        "n", "c", (F.col("c") == last).alias("final"), F.substring("t", (F.col("c") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("t")
    )

    def encode(batches):
        for batch in batches:
            rows = []
            for c, final, text in zip(batch["c"], batch["final"], batch["t"]):
                ends = np.cumsum(encoder(path).widths[encoder(path).ids(text)])
                head = stable_starts(text, 0, overlap, ends) if c else []
                tail = [] if final else stable_starts(text, chunk, chunk + overlap, ends)
                rows.append(([(p + c * chunk, k) for p, k in head], [(p + c * chunk, k) for p, k in tail], len(ends)))
            yield pd.DataFrame({"n": batch["n"], "c": batch["c"], "final": batch["final"],
                                "head": [r[0] for r in rows], "tail": [r[1] for r in rows], "total": [r[2] for r in rows]})

    schema = f"n long, c long, final boolean, head {_PLACES}, tail {_PLACES}, total long"
    coded = settle(pieces.repartition("n", "c").mapInPandas(encode, schema))
    left = coded.select("n", (F.col("c") + 1).alias("seam"), F.inline("tail")).withColumnRenamed("tokens", "before")
    right = coded.select("n", F.col("c").alias("seam"), F.inline("head")).withColumnRenamed("tokens", "again")
    seams = left.join(right, ["n", "seam", "at"]).groupBy("n", "seam").agg(F.min(F.struct("at", "before", "again")).alias("s"))
    spliced = seams.groupBy("n").agg(F.count(F.lit(1)).alias("seams"), F.sum(F.col("s.before") - F.col("s.again")).alias("tokens"))
    totals = coded.groupBy("n").agg(F.max("c").alias("wanted"), F.max(F.when(F.col("final"), F.col("total"))).alias("rest"))
    done = totals.join(spliced, "n", "left").select(
        "n", (F.coalesce("seams", F.lit(0)) == F.col("wanted")).alias("ok"), (F.coalesce("tokens", F.lit(0)) + F.col("rest")).alias("n_tokens")
    )
    return done.where("ok").select("n", "n_tokens"), huge.join(done.where("NOT ok").select("n"), "n", "left_semi")


def token_counts(
    docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; columns
    named like a result are replaced; an empty table stays empty. Documents of up to ``chunk``
    characters are encoded where they are read, without a shuffle.
    """
    small_batches(docs)
    path = path or default_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).count(t) for t in texts], dtype="int64")

    rows = packed(docs, t=text_or_empty(docs, text)).withColumn("size", F.length("t"))
    small = rows.where(F.col("size") <= chunk).select("row", F.octet_length("t").cast("long").alias("n_bytes"), count("t").alias("n_tokens"))
    huge = settle(rows.where(F.col("size") > chunk).withColumn("n", F.monotonically_increasing_id()))
    parts, open_rows, longest = [], huge.select("n", "t", "size"), huge.agg(F.max("size")).first()[0] or 0
    while longest:
        done, again = _rounds(open_rows, path, chunk, overlap)
        parts.append(done)
        if again.isEmpty():
            break
        overlap, open_rows = overlap * 8, again
        chunk = chunk if overlap < longest else max(chunk, longest)
    result = small
    if parts:
        counts = parts[0]
        for part in parts[1:]:
            counts = counts.unionByName(part)
        result = small.unionByName(huge.join(counts, "n").select("row", F.octet_length("t").cast("long").alias("n_bytes"), "n_tokens"))
    result = result.withColumn("over_limit", F.col("n_tokens") > limit)
    return unpacked(result, docs.columns, *RESULTS)
