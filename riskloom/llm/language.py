"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all training documents are added up per task in numpy and summed by Spark, at most
languages x buckets rows from each task. The log-probability matrix (languages x buckets
float32, checked against ``MATRIX_BYTES``) is broadcast; texts are scored in slices of bounded
length, so memory does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import packed, remainder, small_batches, unpacked

LONGEST = 3
BUCKETS = 2**16
SLICE = 2**19
MATRIX_BYTES = 2**28
UNDETERMINED = "und"
MARGIN = 2.0  # nats an n-gram by which a text may fall below its language's median, at least
STRAY = 6.0  # nats by which the sum of n n-grams strays, for each square root of n
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of 1 to ``LONGEST`` code points, lower-cased, with a space
    before and after, slice by slice; slices overlap so that each n-gram comes once."""
    for start in range(0, max(1, len(text)), SLICE):
        part = text[max(0, start - LONGEST + 1) : start + SLICE].lower()
        part = (" " if start == 0 else "") + part + (" " if start + SLICE >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        skip = 0 if start == 0 else LONGEST - 1
        mixed = np.zeros(len(points), dtype=np.uint64)
        for n in range(LONGEST):
            if len(points) <= n:
                break
            mixed = (mixed[: len(points) - n] + points[n:] + np.uint64(1)) * _ODD[n % len(_ODD)]
            hashed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0] >> np.uint64(40)
            yield (hashed[max(0, skip - n) :] % np.uint64(buckets)).astype(np.int64)


def learn(docs: DataFrame, buckets: int = BUCKETS, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts every row with text and language; add-one smoothing; priors by documents."""
    small_batches(docs)
    rows = docs.select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                total = sums.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                total[buckets] += 1  # documents
                for part in grams(text, buckets):
                    total[:buckets] += np.bincount(part, minlength=buckets) if len(part) > buckets else 0
                    if len(part) <= buckets:
                        np.add.at(total, part, 1)
        for lang, total in sums.items():
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": hit, "n": total[hit]})

    sums = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MATRIX_BYTES // (4 * buckets) + 1).collect())
    if 4 * len(languages) * buckets > MATRIX_BYTES:
        raise ValueError(f"more than {MATRIX_BYTES // (4 * buckets)} languages; take fewer buckets")
    counts = np.zeros((len(languages), buckets + 1))
    found = sums.toPandas() if languages else pd.DataFrame({"lang": [], "bucket": [], "n": []})
    counts[np.searchsorted(np.array(languages, dtype=object), found["lang"].to_numpy(dtype=object)) if languages else [], found["bucket"].to_numpy(dtype=np.int64)] = found["n"]
    smooth = counts[:, :buckets] + 1
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else smooth
    documents = counts[:, buckets]
    return LanguageModel(languages, np.ascontiguousarray(log_prob.T, dtype=np.float32), np.log(documents / max(1.0, documents.sum())))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """Language and its posterior; ``und`` with 0 for null, no letter, or an empty model."""
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    total = model.log_prior.copy()
    for part in grams(text, len(model.log_prob)):
        total += model.log_prob[part].sum(axis=0, dtype=np.float64)
    odds = np.exp(total - total.max())
    best = int(odds.argmax())
    return model.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of lang_pred, 0 for ``und``).

    Only the text is looked at. Ties go to the language first in the alphabet. Columns named
    like a result are replaced; empty tables stay empty; repeated rows get equal results.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, shared.value) for t in texts], columns=["lang_pred", "score"])

    rows = packed(docs, p=apply(docs[text].cast("string")))
    return unpacked(rows.select("row", "p.lang_pred", "p.score"), docs.columns, "lang_pred", "score")


def trained_on(docs: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """The documents to learn from: crc32 of the key as text modulo ``folds`` is not 0."""
    return docs.where(remainder(docs[key], folds) != 0)


def closeness(text: str | None, model: LanguageModel) -> tuple[str, float, float, int]:
    """Language, its posterior, the mean log-probability of an n-gram in it, and the n-grams.

    The posterior saturates with the length of a text; the mean does not, and is low for a text
    in none of the languages. ``und`` as in ``predict``.
    """
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0, 0.0, 0
    total, n = np.zeros(len(model.languages)), 0
    for part in grams(text, len(model.log_prob)):
        total += model.log_prob[part].sum(axis=0, dtype=np.float64)
        n += len(part)
    odds = np.exp(total + model.log_prior - (total + model.log_prior).max())
    best = int(odds.argmax())
    return model.languages[best], float(odds[best] / odds.sum()), float(total[best] / n), n


def floors(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """By language, the least mean log-probability of a long text in it.

    That is the median of the documents of that language in ``docs`` (those the model was learned
    from), less ``MARGIN`` or twice the distance from the median to their 5 % quantile, whichever
    is more. Few documents give a flat model, whose floors reject little or nothing.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # The language is compared in the task: a filter on the result would have every text scored twice,
    # by two Python workers at a time.
    @F.pandas_udf("double")
    def apply(texts: pd.Series, langs: pd.Series) -> pd.Series:
        scored = ((closeness(t, shared.value), lang) for t, lang in zip(texts, langs))
        return pd.Series([mean if found == lang else None for (found, _, mean, _), lang in scored], dtype="float64")

    rows = docs.select(docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    scored = rows.select("lang", apply("t", "lang").alias("mean"))
    found = scored.groupBy("lang").agg(F.percentile_approx("mean", [0.5, 0.05], 10000).alias("q")).collect() if model.languages else []
    return {r.lang: r.q[0] - max(MARGIN, 2 * (r.q[0] - r.q[1])) for r in found if r.q is not None}


def belongs(text: str | None, model: LanguageModel, least: dict[str, float], posterior: float = 0.5) -> bool:
    """Whether a text has a letter and is in a learned language, as far as its length can tell.

    Its mean log-probability may be below the language's floor by ``STRAY`` / sqrt(n-grams), so
    texts of a few letters pass. With an empty model every text with a letter belongs.
    """
    if not model.languages:
        return has_letter(text)
    found, score, mean, n = closeness(text, model)
    return n > 0 and score >= posterior and mean >= least.get(found, -np.inf) - STRAY / n**0.5


def in_languages(docs: DataFrame, model: LanguageModel, least: dict[str, float], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``belongs``."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, least))

    @F.pandas_udf("boolean")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([belongs(t, *shared.value) for t in texts], dtype=bool)

    return unpacked(packed(docs, ok=apply(docs[text].cast("string"))).where("ok").select("row"), docs.columns)
