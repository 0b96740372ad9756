"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact size.

1. The rows of every input file are counted; shards get sizes that differ by one row at most.
2. The matrix is drawn on the driver: file by file, how many of its rows go to each shard, by the
   multivariate hypergeometric law given what the shards still take. It is as large as files x
   shards, and never depends on the number of rows.
3. A file's rows are permuted locally: a keyed permutation of 0..n-1 gives each row its new number,
   and the matrix row says which shard takes that number.
4. The exchange: rows move to (shard, run of slots), so a shard is spread over many tasks.
5. A second keyed permutation, of the slots of each shard, forgets which file a row came from.

Both permutations are Feistel networks on just enough bits, walked until they fall inside the
range: no table, no state, the same result when a task is run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import located, packed, place, unpacked
from riskloom.session import settle

RUN = 2**12
ROUNDS = 8
BROADCAST_BYTES = 2**26
LAW_LIMIT = 10**9
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ROUND_KEYS = [np.uint64((i + 1) * 0xBF58476D1CE4E5B9 % 2**64) for i in range(ROUNDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each number of 0..size-1 under the permutation of 0..size-1 that ``key`` names."""
    x, size, key = numbers.astype(np.uint64), size.astype(np.uint64), _mix(key.astype(np.uint64))
    half = np.ones(len(x), dtype=np.uint64)
    for bits in range(2, 33):
        half[size > np.uint64(1) << np.uint64(2 * bits - 2)] = bits
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for round_key in _ROUND_KEYS:
            left, right = right, left ^ (_mix(right + key[todo] + round_key) & mask[todo])
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Files x shards: how many rows of each file each shard takes, for a uniform shuffle.

    Rows sum to ``rows``, columns to shard sizes one apart at most. Each row is drawn as a chain
    of hypergeometric variates. Populations of 10^9 and more, which numpy's sampler does not take,
    use the normal law of the same mean and variance, rounded into the possible range.
    """
    random = np.random.default_rng(seed)
    total = sum(rows)
    free = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    drawn = np.zeros((len(rows), shards), dtype=np.int64)
    for f, n in enumerate(rows):
        rest = int(free.sum())
        for s in range(shards):
            good, bad = int(free[s]), rest - int(free[s])
            if n == 0 or good == 0:
                take = 0
            elif rest < LAW_LIMIT:
                take = int(random.hypergeometric(good, bad, n))
            else:
                share = good / rest
                width = (n * share * (1 - share) * (rest - n) / max(1, rest - 1)) ** 0.5
                take = round(random.normal(n * share, width))
            take = min(max(take, n - bad), good, n)
            drawn[f, s] = take
            rest, n = rest - good, n - take
        free -= drawn[f]
    return drawn


def shard(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (0, 1, ... without a gap in each shard).

    Shard sizes differ by one row at most. Every row is placed, also nulls, empty texts and
    repeated rows, each on its own: rows are told apart by their place in the input's files
    (a frame that reads no files is written once). The rows arrive in order of slot within runs
    of ``RUN`` slots. Columns named like a result are replaced; an empty table stays empty.
    """
    files, docs = _files(docs)
    matrix = communication_matrix([f["n"] for f in files], shards, seed)
    sizes = matrix.sum(axis=0)
    inside = np.cumsum(matrix, axis=1) - matrix  # first local number of each shard
    before = np.cumsum(matrix, axis=0) - matrix  # first place in the shard
    table = docs.sparkSession.createDataFrame(
        [(f["file"], f["n"], inside[i].tolist(), before[i].tolist()) for i, f in enumerate(files)],
        "f long, n long, inside array<long>, before array<long>",
    )
    if 16 * shards * len(files) <= BROADCAST_BYTES:
        table = F.broadcast(table)

    @F.pandas_udf("shard int, slot long")
    def assign(file: pd.Series, row: pd.Series, n: pd.Series, inside: pd.Series, before: pd.Series) -> pd.DataFrame:
        if not len(row):
            return pd.DataFrame({"shard": [], "slot": []}, dtype="int64")
        number = permuted(row.to_numpy(), n.to_numpy(), file.to_numpy() ^ seed)
        inside, before = np.stack(inside.to_numpy()), np.stack(before.to_numpy())
        target = (inside <= number[:, None]).sum(axis=1) - 1
        each = np.arange(len(number))
        at = before[each, target] + number - inside[each, target]
        return pd.DataFrame({"shard": target, "slot": permuted(at, sizes[target], target + np.int64(seed + 1) * 2**32)})

    rows = packed(docs, p=place(docs)).select("row", "p.file", F.col("p.row").alias("r"))
    rows = rows.join(table, F.col("file") == F.col("f")).select("row", assign("file", "r", "n", "inside", "before").alias("to"))
    moved = rows.select("row", "to.shard", "to.slot").repartition("shard", (F.col("slot") / RUN).cast("long"))
    return unpacked(moved.sortWithinPartitions("shard", "slot"), docs.columns, "shard", "slot")


def _files(docs: DataFrame) -> tuple[list, DataFrame]:
    """Rows by file, and the frame to read; a frame that reads files in part is written first."""

    def counted(frame: DataFrame):
        at = place(frame)
        each = frame.select(at.getField("file").alias("file"), at.getField("row").alias("r"))
        return each.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("last")).orderBy("file").collect()

    docs = located(docs)
    files = counted(docs)
    if any(f["n"] != f["last"] + 1 for f in files):
        docs = settle(docs)
        files = counted(docs)
    return files, docs


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; the files of a folder hold runs of slots in order."""
    sharded.write.partitionBy("shard").parquet(path)
