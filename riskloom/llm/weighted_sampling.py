"""Document fingerprints by consistent weighted sampling.

The terms of a document are its word n-grams, weighted by how often they occur. For each sample
every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), fixed for the term; with its weight w it has
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)), and the term with the smallest
a is the sample, together with t. Two documents agree in a sample with a probability that equals
their generalised Jaccard similarity, sum of min weights over sum of max weights.

Draws come from a table of ``TABLE`` rows, picked by the term's hash and equal on every worker;
terms of one row are told apart by their hash, the smaller one going first. A fingerprint keeps
16 bits of each sample, as hex.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import located, place, small_batches, text_or_empty
from riskloom.llm.lsh_forest import WORDS, ngrams

SAMPLES = 64
TABLE = 2**15
CHUNK = 2048
BUCKET_BYTES = 2**20
MOST_BUCKETS = 20_000


@lru_cache(maxsize=1)
def _draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, b, c and the a of weight 1, TABLE x samples."""
    random = np.random.default_rng(60607)
    r = random.gamma(2.0, 1.0, (TABLE, samples)).astype(np.float32)
    c = random.gamma(2.0, 1.0, (TABLE, samples)).astype(np.float32)
    b = random.random((TABLE, samples), dtype=np.float32)
    return r, b, c, c * np.exp(r * b - r)


def fingerprint(text: str, words: int = WORDS, samples: int = SAMPLES) -> np.ndarray:
    """``samples`` numbers from 1 to 65535; all 0 for a text without words."""
    terms, weights = np.unique(ngrams(text, words), return_counts=True)
    if not len(terms):
        return np.zeros(samples, dtype=np.uint16)
    r, b, c, once = _draws(samples)
    best = np.full(samples, np.inf, dtype=np.float32)
    term, level = np.zeros(samples, dtype=np.uint64), np.zeros(samples, dtype=np.int64)
    column = np.arange(samples)
    rows = (terms >> np.uint64(40)).astype(np.int64) % TABLE
    for start in range(0, len(terms), CHUNK):
        part = rows[start : start + CHUNK]
        a = once[part]
        heavy = np.flatnonzero(weights[start : start + CHUNK] > 1)
        t = np.zeros((0, samples))
        if len(heavy):
            h = part[heavy]
            t = np.floor(np.log(weights[start + heavy, None]) / r[h] + b[h])
            a[heavy] = c[h] * np.exp(-r[h] * (t - b[h]) - r[h])
        least = a.argmin(axis=0)
        better = a[least, column] < best
        best[better], term[better] = a[least, column][better], terms[start + least[better]]
        at = np.searchsorted(heavy, least)
        found = (at < len(heavy)) & (heavy[np.minimum(at, len(heavy) - 1)] == least) if len(heavy) else np.zeros(samples, dtype=bool)
        levels = np.where(found, t[np.minimum(at, len(heavy) - 1), column] if len(heavy) else 0, 0).astype(np.int64)
        level[better] = levels[better]
    mixed = (term ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(33)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """One row (key as doc_id, n_chars, fingerprint) per row of ``docs``, without a shuffle."""
    small_batches(docs)
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            texts = batch["t"]
            yield pd.DataFrame({"doc_id": batch["k"], "n_chars": texts.map(len), "fingerprint": [_hex(fingerprint(t, words, samples)) for t in texts]})

    return docs.select(docs[key].alias("k"), text_or_empty(docs, text).alias("t")).mapInPandas(
        apply, f"doc_id {kind}, n_chars long, fingerprint string"
    )


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (bucket, copy, k, id, h, t), each bucket a range of the order, sorted in tasks.

    Ascending order: key (null lowest), then a hash of the row's place. Ranges end at approximate
    quantiles of the key; a key that holds several quantiles is dealt over several ranges by that
    hash. The last row of each range comes again (copy 0) before the first row of the next, and
    the very last before the very first, so each row finds its neighbour in its own bucket.
    """
    docs = located(docs)
    at = place(docs)
    lowest = F.lit(-(2**63)).cast("long")
    number = F.coalesce(docs[key].cast("long"), lowest)
    rows = docs.select(docs[key].alias("id"), number.alias("k"), F.xxhash64(at).alias("h"), text_or_empty(docs, text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("bytes")).first()["bytes"] or 0
    count = int(min(MOST_BUCKETS, max(1, total // BUCKET_BYTES)))
    shares = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx("k", shares, max(10_000, 10 * count))).first()[0] if shares else []
    ends = np.array(sorted(found or []), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series, h: pd.Series) -> pd.Series:
        low, high = np.searchsorted(ends, k.to_numpy(), "left"), np.searchsorted(ends, k.to_numpy(), "right")
        share = (h.to_numpy() / 2.0**64) + 0.5
        return pd.Series(low + np.minimum(high - low, np.floor(share * (high - low + 1)).astype(np.int64)), dtype="int32")

    rows = rows.withColumn("bucket", bucket_of("k", "h"))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("top")).collect())
    after = [b for b, _ in tops[1:]] + [b for b, _ in tops[:1]]
    copies = docs.sparkSession.createDataFrame([(t["k"], t["h"], b) for (_, t), b in zip(tops, after)], "k long, h long, also int")
    # one row for each bucket: MOST_BUCKETS at most
    rows = rows.join(F.broadcast(copies), ["k", "h"], "left").withColumn(
        "to", F.explode(F.expr("filter(array(struct(1 AS copy, bucket AS b), struct(0 AS copy, also AS b)), x -> x.b IS NOT NULL)"))
    )
    rows = rows.select(F.col("to.b").alias("bucket"), F.col("to.copy").alias("copy"), "k", "id", "h", "t")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "copy", "k", "h")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``).

    The next document follows in descending order of the key; after the last comes the first,
    and a single document is its own next. Null keys come last, rows with equal keys in an order
    fixed by their place in the input. A null text counts as empty; two texts without words are
    alike (1), one with and one without are not (0). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. An empty table gives an empty table.
    """
    small_batches(docs)
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches):
        last, last_print = "", np.zeros(samples, dtype=np.uint16)
        for batch in batches:
            out = []
            for copy, doc, t in zip(batch["copy"], batch["id"].array, batch["t"]):
                own = fingerprint(t, words, samples)
                if copy:
                    changed = edited(t, last)
                    other = fingerprint(changed, words, samples)
                    out.append((doc, len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                _hex(own), _hex(other), likeness(own, other), likeness(own, last_print)))
                last, last_print = t, own
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.assign(doc_id=frame["doc_id"].astype(batch["id"].dtype))

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, key, text).mapInPandas(apply, schema)
