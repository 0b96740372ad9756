"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over its
distinct lower-case words, each with its hashed character ``CHARS``-grams; the document is toxic
unless all its sentences and a fixed background leak are clean: P = 1 - (1 - leak) * prod(1 - p_s).
Only document labels exist; the model is fitted to them through this combination (gradient of the bag
likelihood), so it learns which sentences carry the label. Scoring keeps the sentence
scores: the worst sentence and every sentence at or above ``FLAG`` are located by code-point span.

Which buckets may carry weight is decided first, over every labelled document to learn from: those
that toxic documents hold more often than clean ones by ``EVIDENCE`` standard errors (tasks count
documents by bucket, Spark adds up and compares). The many buckets of chance words and of a language's
common ones stay at 0, so a long clean document does not gather a score from them.

The weights are fitted on at most ``fit_rows`` labelled keys (those that hash lowest), each once, brought
to the driver as packed numbers of such buckets; scoring runs over every document in Arrow batches with
the weights broadcast (``BUCKETS`` floats, 1 MB). Labels, keys and other columns are never features.

Nulls: a null text is the empty text, with no sentences, and scores the leak alone; a null or
missing label is not learned from. Repeated rows are scored each; a repeated labelled key is
learned once. An empty table gives an empty result; a table without usable labels gives the
model that knows nothing (all scores 0.5, no flag). Columns of the caller keep their names; a
result replaces a column of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import packed, small_batches, text_or_empty, unpacked
from riskloom.session import settle

BUCKETS = 1 << 18
FIT_ROWS = 4_000
FLAG = 0.5
STEPS, RATE, START, L2 = 300, 0.05, 2.0, 5e-5
#: A bucket may carry weight if toxic documents hold it LIFT times as often as clean ones, by so many standard errors,
#: and so many hold it; where none does, as in small tables, the FEW best ones.
LIFT, EVIDENCE, DOCUMENTS, FEW = 2.0, 4.0, 5, 64
#: Words a worker keeps the buckets or the weight of.
KNOWN = 1 << 18
#: The background probability of a toxic label that no sentence explains; fixed, so that labels are
#: explained by sentences (a learned leak takes the base rate and leaves the sentences nothing to learn).
LEAK = 0.01
CHARS = 4
RESULTS = ("score", "n_sentences", "worst_start", "worst_end", "worst_score", "flagged")
FLAGGED = "array<struct<start:long,end:long,score:double>>"
#: A sentence: from a non-blank to the next . ! ? (with all of them) or newline.
SENTENCE = re.compile(r"[^\s.!?][^.!?\n]*[.!?]*")
WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)]


class _Buckets(dict):
    """A word's distinct buckets: the word itself and its ``CHARS``-grams with borders."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        edged = f"<{word}>"
        grams = [word, *(f"#{edged[i:i + CHARS]}" for i in range(max(1, len(edged) - CHARS + 1)))]
        found = tuple({xxhash.xxh32_intdigest(g) & (BUCKETS - 1) for g in grams})
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found
        return found


_WORDS = _Buckets()


def _distinct(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def features(sentence: str) -> np.ndarray:
    """Buckets of the sentence's distinct lower-case words; one that several words share comes so often."""
    return np.array([b for w in _distinct(sentence) for b in _WORDS[w]], np.int64)


def bag(text: str, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentences' buckets where ``chosen`` (a flag by bucket), one after another, and each sentence's end in them."""
    found = [f[chosen[f]] for f in (features(text[a:z]) for a, z in sentences(text))]
    ends = np.cumsum([len(f) for f in found], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int64), *found]), ends


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    leak: float

    def document_score(self, p: np.ndarray) -> float:
        clean = np.log1p(-self.leak) + np.sum(np.log1p(-np.minimum(p, 1 - 1e-15)))
        return float(-np.expm1(clean))


class _Weights(dict):
    """A word's part in the score of a sentence: the weights of its buckets added up."""

    def __init__(self, model: ToxicityModel):
        self.weights, self.bias = model.weights.tolist(), model.bias

    def __missing__(self, word: str) -> float:
        found = sum(self.weights[b] for b in _WORDS[word])
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found
        return found

    def sentence_scores(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        z = [sum(map(self.__getitem__, _distinct(text[a:b]))) for a, b in spans]
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + np.array(z, float), -700, 700)))


def _softplus(z):
    return np.logaddexp(0.0, z)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, chosen: np.ndarray, steps: int = STEPS) -> ToxicityModel:
    """Noisy-or bag likelihood by full batches with Adam's steps; ``bags``: (chosen buckets, sentence ends) per document."""
    if not len(bags):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -30.0, 0.5)
    numbers = np.flatnonzero(chosen)
    counts = np.array([len(e) for _, e in bags])
    sent_doc = np.repeat(np.arange(len(bags)), counts)
    at = np.searchsorted(numbers, np.concatenate([b for b, _ in bags]))
    sizes = np.concatenate([np.diff(e, prepend=0) for _, e in bags])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    y = labels.astype(float)
    n, k = len(bags), len(numbers)
    leak = np.log1p(-LEAK)
    theta = np.append(np.full(k, START), -5.0)  # the bias comes last
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = theta[k] + np.bincount(owner, weights=theta[at], minlength=len(sizes))
        s_doc = leak - np.bincount(sent_doc, weights=_softplus(z), minlength=n)
        d_s = np.where(y > 0, np.exp(s_doc) / np.maximum(-np.expm1(s_doc), 1e-12), -1.0) / n
        g_sent = -d_s[sent_doc] / (1.0 + np.exp(-z))
        grads = np.append(np.bincount(at, weights=g_sent[owner], minlength=k) + L2 * theta[:k], g_sent.sum())
        mean, square = 0.9 * mean + 0.1 * grads, 0.99 * square + 0.01 * grads**2
        theta = theta - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[numbers] = theta[:k]
    return ToxicityModel(weights, float(theta[k]), LEAK)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label by bucket; bucket -1 counts them all."""
    seen, total = np.zeros((2, BUCKETS), np.int64), [0, 0]
    for batch in batches:
        for text, y in zip(batch["t"], batch["y"] > 0):
            held = set().union(*(_WORDS[w] for w in _distinct(text)))
            seen[int(y), np.fromiter(held, np.int64, len(held))] += 1
            total[int(y)] += 1
    some = np.flatnonzero(seen.any(0))
    yield pd.DataFrame({"bucket": np.append(some, -1), "clean": np.append(seen[0, some], total[0]), "toxic": np.append(seen[1, some], total[1])})


def evidence(one: DataFrame) -> np.ndarray:
    """A flag by bucket: toxic documents of ``one`` (t, y) hold it more often than clean ones, beyond chance."""
    counts = one.mapInPandas(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = settle(counts)
    chosen = np.zeros(BUCKETS, bool)
    every = counts.where("bucket = -1").first()
    if every is None or not every["clean"] or not every["toxic"]:
        return chosen
    n, p = F.lit(float(every["clean"])), F.lit(float(every["toxic"]))
    share = (F.col("clean") + F.col("toxic")) / (n + p)
    surplus = F.col("toxic") / p - F.col("clean") / n
    z = surplus / F.sqrt(share * (1 - share) * (1 / n + 1 / p))
    ranked = counts.where("bucket >= 0").select("bucket", "toxic", F.when(share < 1, z).alias("z"), (F.col("toxic") / p >= LIFT * F.col("clean") / n).alias("lifted")).where("z > 0")
    found = ranked.where(F.col("lifted") & (F.col("z") >= EVIDENCE) & (F.col("toxic") >= DOCUMENTS)).select("bucket").toPandas()
    if not len(found):
        found = ranked.orderBy(F.desc("z"), "bucket").limit(FEW).select("bucket").toPandas()
    chosen[found["bucket"].to_numpy()] = True
    return chosen


def fit(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Buckets chosen on every labelled key where ``learn`` (an expression of ``labels``) holds, weights fitted on
    at most ``fit_rows`` of these keys."""
    small_batches(docs)
    usable = labels.where(learn & labels[label].isNotNull() & labels[key].isNotNull())
    usable = usable.groupBy(key).agg(F.max(label).alias("y"))
    rows = docs.select(docs[key].alias(key), text_or_empty(docs, text).alias("t"))

    def once(some: DataFrame) -> DataFrame:
        return rows.join(some, key).groupBy(key).agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("y").cast("int").alias("y"))

    shared = docs.sparkSession.sparkContext.broadcast(evidence(once(usable)))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [bag(t, shared.value) for t in batch["t"]]
            yield pd.DataFrame({"y": batch["y"], "feats": [b.astype(np.int32).tobytes() for b, _ in bags], "ends": [e.tobytes() for _, e in bags]})

    chosen = usable.orderBy(F.xxhash64(key), key).limit(fit_rows)
    got = once(chosen).mapInPandas(encoded, "y int, feats binary, ends binary").toPandas()
    bags = [(np.frombuffer(f, np.int32).astype(np.int64), np.frombuffer(e, np.int64)) for f, e in zip(got["feats"], got["ends"])]
    return train(bags, got["y"].to_numpy(), shared.value)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with RESULTS: score (0 to 1), sentence count, the worst sentence's span and score, and the flagged spans."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))
    kinds = "score double, n_sentences long, worst_start long, worst_end long, worst_score double, f_start array<long>, f_end array<long>, f_score array<double>"

    @F.pandas_udf(kinds)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = ToxicityModel(*shared.value)
        words = _Weights(here)
        for texts in batches:
            out = {k: [] for k in ("score", "n_sentences", "worst_start", "worst_end", "worst_score", "f_start", "f_end", "f_score")}
            for t in texts:
                spans = sentences(t)
                p = words.sentence_scores(t, spans)
                worst = int(np.argmax(p)) if len(p) else None
                flagged = [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= FLAG)]
                out["score"].append(here.document_score(p))
                out["n_sentences"].append(len(spans))
                out["worst_start"].append(None if worst is None else spans[worst][0])
                out["worst_end"].append(None if worst is None else spans[worst][1])
                out["worst_score"].append(None if worst is None else float(p[worst]))
                out["f_start"].append([f[0] for f in flagged])
                out["f_end"].append([f[1] for f in flagged])
                out["f_score"].append([f[2] for f in flagged])
            yield pd.DataFrame(out)

    frame = packed(docs, r=scored(text_or_empty(docs, text)))
    spans = F.arrays_zip(F.col("r.f_start").alias("start"), F.col("r.f_end").alias("end"), F.col("r.f_score").alias("score"))
    done = frame.select("row", *[F.col(f"r.{k}").alias(k) for k in RESULTS[:-1]], spans.cast(FLAGGED).alias("flagged"))
    return unpacked(done, docs.columns, *RESULTS)
