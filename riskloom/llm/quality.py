"""Document quality: a classifier per document, corrected by hierarchical empirical Bayes.

Three levels: the table as a whole, hosts (``source``), and paths of a host (``source`` and
``lang``, as in /fr/ or /de/ sections of a site). A document's own evidence is a logistic model
over measures of its whole text. The evidence of all documents is summed by path, and again by
host. A host's posterior mean is shrunk toward the table's, a path's toward its host's; how far
is set by the moments of the level itself: where sites differ no more than chance, they say
nothing. The log odds of document and path are added, less the table's, which both contain.

The model is fitted on at most ``fit_rows`` labelled keys (those that hash lowest), one row each; all
sums cover all documents. Sites are aggregated on the map side before they shuffle and written
once; Spark broadcasts that table only if its files are small, and otherwise joins by key.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import packed, small_batches, text_or_empty, unpacked
from riskloom.session import settle

FIT_ROWS = 20_000
RESULTS = ("document_prob", "host_posterior", "path_posterior", "quality", "kept")
_MARKS = re.compile(r"[^\w\s.,;:'’\"()\-¿?¡!«»]")
_SHOUT = re.compile(r"[!?]{2,}")


def measures(text: str) -> list[float]:
    """Shares and logs; all 0 for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * 10
    n, size = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    return [
        len(_MARKS.findall(text)) / n,
        min(1.0, len(_SHOUT.findall(text)) / n),
        upper / n,
        again / n,
        1.0 - len(set(words)) / (n**0.8 + 1.0),
        1.0 - len(set(lines)) / len(lines),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        math.log(size / n),
        math.log1p(n),
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def probabilities(self, texts: pd.Series) -> np.ndarray:
        x = (np.array([measures(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        odds = np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1.0 / (1.0 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Newton's method with a ridge of 1 on standardised measures of at most ``fit_rows`` rows.

    Labels other than 0 and 1 are left out. A label (key and value) counts once however often it
    or its document is repeated; of documents of one key the smallest measures are taken. Without
    any labelled row the model says 1/2.
    """
    small_batches(docs)
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).where("y IN (0, 1)").distinct()
    wanted = known.orderBy(F.xxhash64("k"), "k", "y").limit(fit_rows)
    rows = docs.select(docs[key].alias("k"), text_or_empty(docs).alias("t")).join(F.broadcast(wanted), "k")

    def measured(batches):
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"].astype(str), "y": batch["y"], "x": [measures(t) for t in batch["t"]]})

    each = rows.mapInPandas(measured, "k string, y int, x array<double>").groupBy("k", "y").agg(F.min("x").alias("x"))
    found = each.toPandas().sort_values(["k", "y"])
    width = len(measures("")) + 1
    if found.empty:
        return QualityModel(np.zeros(width - 1), np.ones(width - 1), np.zeros(width))
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy(dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weights = np.zeros(width)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        ridge = np.append(np.ones(width - 1), 1e-3)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return QualityModel(mean, scale, weights)


def _strength(n: Column, share: Column, prior: Column) -> list[Column]:
    """Sums from which a level's Beta strength follows by the method of moments."""
    return [
        F.sum(n * (share - prior) ** 2).alias("spread"), F.sum(n).alias("rows"),
        F.sum(prior * (1 - prior)).alias("chance"), F.sum(n * prior * (1 - prior)).alias("unit"),
    ]


def _solved(sums) -> float:
    """Pseudo-rows k of the prior: Var(share) = p(1-p)/n * (1 + (n-1)/(k+1)), solved for k.

    No more spread than chance gives: a strength of a million rows; the level says nothing.
    """
    if not sums or not sums["rows"] or not sums["unit"]:
        return 1e6
    excess = (sums["spread"] - sums["chance"]) / max(sums["unit"] - sums["chance"], 1e-12)
    return float(min(1e6, max(1.0, 1.0 / excess - 1.0))) if excess > 1e-6 else 1e6


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, p) to one row per host and path with host_posterior, path_posterior, base."""
    paths = settle(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / (total["n"] or 1)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k = _solved(hosts.agg(*_strength(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(base))).first())
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hs") + k * base) / (F.col("hn") + k)).alias("host_posterior"))
    both = settle(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    k = _solved(both.agg(*_strength(F.col("n"), F.col("s") / F.col("n"), F.col("host_posterior"))).first())
    posterior = (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)
    return both.select("host", "path", "host_posterior", posterior.alias("path_posterior"), F.lit(base).alias("base"))


def classify(
    docs: DataFrame, model: QualityModel, text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5,
) -> DataFrame:
    """``docs`` with document_prob, host_posterior, path_posterior, quality (0 to 1) and kept.

    ``kept`` is quality >= ``threshold``. A null text counts as empty. A null host or path is a
    site of its own. Repeated rows count each. Columns named like a result are replaced; an
    empty table stays empty.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probabilities(texts))

    rows = packed(docs, host=docs[host].cast("string"), path=docs[path].cast("string"), p=probability(text_or_empty(docs, text)))
    sites = settle(site_posteriors(rows.select("host", "path", "p")))
    sites = sites.withColumnsRenamed({"host": "h", "path": "q"})

    def odds(p: Column) -> Column:
        p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
        return F.log(p / (1 - p))

    joined = rows.join(sites, rows.host.eqNullSafe(sites.h) & rows.path.eqNullSafe(sites.q))
    mixed = odds(F.col("document_prob")) + odds(F.col("path_posterior")) - odds(F.col("base"))
    out = joined.withColumnRenamed("p", "document_prob").withColumn("quality", 1 / (1 + F.exp(-mixed)))
    return unpacked(out.withColumn("kept", F.col("quality") >= threshold), docs.columns, *RESULTS)
