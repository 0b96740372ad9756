import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import queries, toxicity


def _direct(model, text):
    """Noisy-or of the sentence scores, one sentence at a time."""
    clean = 1 - model.leak
    for a, b in toxicity.sentences(text or ""):
        z = model.bias + float(sum(model.weights[toxicity.features(text[a:b])].astype(float)))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_toxicity(spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in got.collect() if r.doc_id in labels and r.held_out]
    assert held
    right = sum(p == y for p, y in held) / len(held)
    base = max(np.mean([y for _, y in held]), 1 - np.mean([y for _, y in held]))
    assert right >= base
    assert not any(p and not y for p, y in held)


def test_planted_sentences_are_located(spark):
    texts = [
        (1, "The weather was fine today. We walked along the river.", 0),
        (2, "The weather was fine today. You are a pathetic loser and an idiot. We walked home.", 1),
    ] * 30 + [(3, "Nothing here at all. Just a calm report on trains.", 0)] * 30 + [(4, "What a worthless moron, pure trash.", 1)] * 30
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, _, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    probe = spark.createDataFrame([(0, "A calm day by the river. Such an idiot and a loser! Then tea.")], "doc_id long, text string")
    row = toxicity.score(probe, model).first()
    assert row.score >= 0.7
    assert probe.first().text[row.worst_start:row.worst_end] == "Such an idiot and a loser!"
    assert [(f.start, f.end) for f in row.flagged] == [(row.worst_start, row.worst_end)]


def test_score_is_the_noisy_or(spark, edges):
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(rng.normal(0, 2, toxicity.BUCKETS).astype(np.float32), -4.0, 0.01)
    got = toxicity.score(edges, model).collect()
    for r in got:
        assert abs(r.score - _direct(model, r.text)) < 1e-9
        assert 0 <= r.score <= 1
    empty = [r for r in got if not (r.text or "").strip()]
    assert empty and all(abs(r.score - 0.01) < 1e-12 and r.n_sentences == 0 and r.worst_start is None for r in empty)


def test_edges_clashes_and_no_labels(spark, edges, clashing, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels, F.lit(True))
    assert [round(r.score, 9) for r in toxicity.score(edges, model).collect()] == [0.5] * len(edges.collect())
    scored = toxicity.score(clashing, model)
    assert scored.count() == clashing.count() and set(clashing.columns) <= set(scored.columns)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels, F.lit(True)).bias == -30.0


def test_held_out_scores_rank_label_1_above_label_0(spark):
    """Toxic words in one sentence of documents of any length, beside chance words that occur once."""
    rng = np.random.default_rng(5)
    common = ["".join(rng.choice(list("aeiourstln"), 4)) for _ in range(60)]
    rows = []
    for i in range(600):
        words = [str(w) for w in rng.choice(common, rng.integers(40, 400))] + ["".join(rng.choice(list("bcdfghkmp"), 9)) for _ in range(20)]
        rng.shuffle(words)
        if i % 8 == 0:
            words[len(words) // 2] = ["moron", "worthless", "scum"][i % 3]
        lines = [" ".join(words[j:j + 10]) for j in range(0, len(words), 10)]
        rows.append((i, ". ".join(lines) + ".", int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 16 < 8)
    held = [(r.score, rows[r.doc_id][2]) for r in toxicity.score(docs, model).collect() if r.doc_id % 16 >= 8]
    toxic, clean = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert len(toxic) and len(clean)
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
