"""Language-model scores by deleted interpolation.

p_1(w) is the add-one estimate of single tokens. For n-grams of order k = 2 and up,

    p_k(w | h) = l * C(h w) / C(h) + (1 - l) * p_(k-1)(w | shorter h),

with l taken by the bucket (powers of two) of the context's count C(h); l = 0 for a context never
seen. The weights of a bucket are those that give the training tokens the highest likelihood when
each token's own occurrence is deleted from all counts (held-out counts), found by
expectation-maximisation. With one weight for each bucket it needs no more than how often each
ratio of the two estimates occurs; that histogram (buckets x ``BINS``) is all the driver gets.

Counting works on blocks of documents, as requests and answers:
 1. a block asks for its distinct n-grams: sorted 64-bit hashes, with its own training counts,
    cut into ranges of the hash space, one packet for each range;
 2. a range adds up the counts of equal hashes and answers each packet with totals, in its order;
 3. a block puts the answers back in order and looks up every token of its documents.
So a frequent n-gram travels once for each block, ranges are even by hashing, and the traffic
follows the number of distinct n-grams of the blocks. All n-grams are counted; nothing is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import located, place, remainder, small_batches, text_or_empty
from riskloom.session import settle

ORDER = 2
BLOCK_BYTES = 2**23
RANGE_BYTES = 2**23
BUCKETS = 64
BINS = 4096
STEPS = 16  # bins for each power of two of the ratio
TOTALS = np.uint64  # of the whole table; a block's own counts fit 32 bits
END = b"\n"  # no word contains it
_START, _ODD = np.uint64(0x452821E638D01377), np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 2**18:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then one end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def packed(numbers: np.ndarray) -> bytes:
    """Compressed by byte planes, which suits small and slowly growing numbers."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _ngrams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the texts; hashes (order x tokens) of the n-grams that end at each token."""
    parts = []
    for text in texts:
        found = tokens(text)
        parts.append(np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found)))
    words, lengths = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    out, history = np.empty((order, len(words)), dtype=np.uint64), words
    out[0] = words
    for k in range(1, order):
        before = np.empty_like(history)
        before[1:] = history[:-1]
        before[first] = _START + np.uint64(k)
        history = (before ^ (before >> np.uint64(31))) * _ODD + words
        history ^= history >> np.uint64(29)
        out[k] = history * _ODD ^ np.uint64(k)
    return lengths, out


def _answered(frame: pd.DataFrame) -> pd.DataFrame:
    """The packets of one range with totals for counts."""
    grams = [np.cumsum(unpacked(g, np.uint64), dtype=np.uint64) for g in frame["grams"]]
    counts = np.concatenate([unpacked(c, np.uint32) for c in frame["counts"]])
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(at, weights=counts)[at].astype(TOTALS)
    ends = np.cumsum([len(g) for g in grams])
    return pd.DataFrame({"range": frame["range"], "block": frame["block"], "totals": [packed(t) for t in np.split(totals, ends[:-1])]})


def _looked_up(frame: pd.DataFrame, answers: pd.DataFrame, order: int) -> pd.DataFrame:
    """The documents of one block with the totals of their n-grams."""
    frame = frame.sort_values("place")
    lengths, grams = _ngrams(frame["t"].tolist(), order)
    _, at = np.unique(grams.reshape(-1), return_inverse=True)
    totals = np.concatenate([unpacked(t, TOTALS) for t in answers.sort_values("range")["totals"]])
    counts = totals[at].reshape(order, -1)
    starts = np.cumsum(lengths) - lengths
    each = 1.0 / np.maximum(1, counts[0])
    return pd.DataFrame({
        "k": frame["k"], "train": frame["train"], "tokens": lengths,
        "known": np.add.reduceat((counts[0] > 0).astype(np.int64), starts), "types": np.add.reduceat(each, starts),
        "counts": [packed(np.ascontiguousarray(counts[:, a : a + n]).reshape(-1)) for a, n in zip(starts, lengths)],
    })


def _counted(rows: DataFrame, order: int, ranges: int, kind: str) -> DataFrame:
    """Per document (k, train): tokens, known, types (each training token counts 1 / its count,
    which adds up to the number of distinct ones) and the packed counts of its n-grams."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        lengths, grams = _ngrams(frame["t"].tolist(), order)
        known, at = np.unique(grams.reshape(-1), return_inverse=True)
        mine = np.tile(np.repeat(frame["train"].to_numpy(), lengths), order)
        counts = np.bincount(at[mine], minlength=len(known)).astype(np.uint32)
        cut = np.searchsorted(known >> shift if ranges > 1 else np.zeros(len(known), dtype=np.uint64), np.arange(ranges + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        steps = [np.diff(known[cut[r] : cut[r + 1]], prepend=np.uint64(0)) for r in some]
        return pd.DataFrame({"range": some, "block": frame["block"].iloc[0], "grams": [packed(s) for s in steps],
                             "counts": [packed(counts[cut[r] : cut[r + 1]]) for r in some]})

    def look_up(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _looked_up(frame, answers, order)

    asked = rows.groupBy("block").applyInPandas(ask, "range long, block long, grams binary, counts binary")
    answers = asked.groupBy("range").applyInPandas(_answered, "range long, block long, totals binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        look_up, f"k {kind}, train boolean, tokens long, known long, types double, counts binary"
    )


class Model:
    """Totals of the training tokens, and the weights learned so far, by order and bucket."""

    def __init__(self, total: int, types: int, documents: int):
        self.total, self.types, self.documents, self.weights = total, types, documents, {}

    def contexts(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the context one shorter, at every token of one document."""
        return np.concatenate([[self.documents], counts[:-1]]).astype(np.float64)

    def estimates(self, counts: np.ndarray, deleted: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the highest order given: ratio of its estimate to the mixture below it, bucket of the
        context, and that mixture. ``deleted`` 1: each token without its own occurrence."""
        p = (np.maximum(counts[0] - float(deleted), 0) + 1) / (self.total - deleted + self.types + 1)
        for k in range(2, len(counts) + 1):
            context = self.contexts(counts[k - 2]) - deleted
            ratio = np.where(context > 0, (counts[k - 1] - float(deleted)) / np.maximum(context, 1) / p, 0.0)
            bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)
            if k == len(counts):
                return ratio, bucket, p
            weight = self.weights[k][bucket]
            p = p * (1 - weight + weight * ratio)
        return np.ones(len(p)), np.zeros(len(p), dtype=np.int64), p

    def log10(self, counts: np.ndarray) -> float:
        ratio, bucket, p = self.estimates(counts)
        weight = self.weights[len(counts)][bucket] if len(counts) > 1 else 0.0
        return float(np.log10(p * (1 - weight + weight * ratio)).sum())


def learned_weights(histogram: np.ndarray) -> np.ndarray:
    """Expectation-maximisation for each bucket, from how often (buckets x bins) ratios occur."""
    ratios = np.concatenate([[0.0], 2.0 ** ((np.arange(1, BINS) - BINS // 2) / STEPS)])
    weights = np.full(BUCKETS, 0.5)
    sums = histogram.sum(axis=1)
    for _ in range(500):
        part = weights[:, None] * ratios
        new = (histogram * part / (part + 1 - weights[:, None])).sum(axis=1) / np.maximum(1, sums)
        new = np.clip(new, 1e-9, 1 - 1e-9)
        done = np.abs(new - weights).max() < 1e-10
        weights = new
        if done:
            break
    weights[sums == 0] = 0.0
    weights[0] = 0.0
    return weights


def learn(counted: DataFrame, order: int = ORDER) -> Model:
    """Totals and weights from the training rows of a counted table; all rows are used."""
    train = counted.where("train")
    sums = train.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.count(F.lit(1)).alias("d")).first()
    model = Model(sums["n"] or 0, round(sums["v"] or 0.0), sums["d"])
    for k in range(2, order + 1):

        def ratios(batches, k=k):
            sums = np.zeros((BUCKETS, BINS), dtype=np.int64)
            for batch in batches:
                for data in batch["counts"]:
                    counts = unpacked(data, TOTALS).reshape(order, -1)[:k]
                    ratio, bucket, _ = model.estimates(counts, deleted=1)
                    bins = np.zeros(len(ratio), dtype=np.int64)
                    more = ratio > 0
                    bins[more] = np.clip(np.rint(np.log2(ratio[more]) * STEPS) + BINS // 2, 1, BINS - 1)
                    np.add.at(sums, (bucket, bins), 1)
            hit = np.nonzero(sums)
            yield pd.DataFrame({"bucket": hit[0], "bin": hit[1], "n": sums[hit]})

        found = train.select("counts").mapInPandas(ratios, "bucket long, bin long, n long").groupBy("bucket", "bin").agg(F.sum("n").alias("n")).toPandas()
        histogram = np.zeros((BUCKETS, BINS))
        histogram[found["bucket"].to_numpy(dtype=np.int64), found["bin"].to_numpy(dtype=np.int64)] = found["n"]
        model.weights[k] = learned_weights(histogram)
    return model


def _scored(counted: DataFrame, model: Model, order: int) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("base double, score double")
    def apply(data: pd.Series) -> pd.DataFrame:
        counts = [unpacked(d, TOTALS).reshape(order, -1) for d in data]
        return pd.DataFrame([(shared.value.log10(c[:1]), shared.value.log10(c)) for c in counts], columns=["base", "score"])

    return counted.withColumn("s", apply("counts")).select(
        F.col("k").alias("doc_id"), (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), F.col("s.base").alias("base_score"), F.col("s.score").alias("score"),
    )


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(key as text) modulo ``folds`` is not ``held_out`` and
    scores all; both scores are log10 probabilities of the whole text with its end. A null or
    empty text is one end; a null key counts as the empty text. Repeated rows are learned and
    scored each. Without a training document each token scores 0. An empty table stays empty.
    """
    small_batches(docs)
    docs = located(docs)
    kind = docs.schema[key].dataType.simpleString()
    at = place(docs)
    rows = docs.select(docs[key].alias("k"), (remainder(docs[key], folds) != held_out).alias("train"), F.xxhash64(at).alias("place"), text_or_empty(docs, text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 1).alias("n")).first()["n"] or 0
    blocks, ranges = size // block_bytes + 1, 1 << (size // RANGE_BYTES).bit_length()
    rows = rows.withColumn("block", F.pmod(F.col("place"), F.lit(blocks)))
    counted = settle(_counted(rows, order, ranges, kind))
    return _scored(counted, learn(counted, order), order)
