import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from riskloom.llm import language, lsh_forest, quality
from riskloom.session import settle


def test_stages(spark, folder, docs):
    """Each stage against what its operator says of its own input."""
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = settle(stage(spark, before, folder))
        assert after.columns == docs.columns
        left, right = before.select("doc_id").collect(), after.select("doc_id").collect()
        assert {r.doc_id for r in right} <= {r.doc_id for r in left} and len(right) == len({r.doc_id for r in right})
        if name == "exact_dedup":
            folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            wanted = before.groupBy(folded.alias("f")).agg(F.max("doc_id").alias("m")).collect()
            assert {r.doc_id for r in right} == {r.m for r in wanted}
        if name == "ngram_jaccard":
            assert {r.doc_id for r in right} == {r.class_id for r in lsh_forest.near_duplicates(before).collect()}
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, before, folder)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_clean_documents_stay(spark, folder, docs):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    good = docs.join(labels, "doc_id").select(docs.columns)
    kept = good
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = settle(stage(spark, kept, folder))
    assert kept.count() >= 0.99 * good.count()


def letters(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


STRANGE = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 50,
    *(letters(n, n) for n in (8, 60, 3000)),
]


def test_languages_never_learned_and_gibberish_go(spark, folder, docs):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id").select(docs.columns)
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(STRANGE)], "doc_id long, text string, lang string")
    frame = settle(good.unionByName(planted, allowMissingColumns=True))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, frame, folder).collect()}
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.99 * good.count()


def test_documents_stay_where_no_language_is_known(spark, folder, edges):
    frame = settle(edges.withColumn("lang", F.lit(None).cast("string")))
    kept = corpus_pipeline.language_id(spark, frame, folder).collect()
    assert len(kept) == sum(any(map(str.isalpha, r.text or "")) for r in edges.collect()) == 10


def test_floors_score_each_text_once(spark, folder, docs, monkeypatch):
    """A filter on what a Python function gives had Spark run it twice, in two workers at a time."""
    known = settle(language.trained_on(docs).unionByName(docs.limit(3).withColumn("lang", F.lit("zz"))))
    model = language.learn(language.trained_on(docs))
    plans, kind = [], type(docs)
    collect = kind.collect

    def noted(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return collect(frame)

    monkeypatch.setattr(kind, "collect", noted)
    found = language.floors(known, model)
    assert sum(plan.count("ArrowEvalPython") for plan in plans) == 1
    monkeypatch.undo()
    means = {}
    for r in known.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").collect():
        lang, _, mean, _ = language.closeness(r.text, model)
        if lang == r.lang:
            means.setdefault(lang, []).append(mean)
    assert set(found) == set(means) and "zz" not in found
    for lang, each in means.items():
        low, middle = sorted(each)[-(-len(each) * 5 // 100) - 1], sorted(each)[-(-len(each) // 2) - 1]
        assert found[lang] == pytest.approx(middle - max(language.MARGIN, 2 * (middle - low)), abs=1e-9)


def test_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(contract.oracle_sql()) <= set(names)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_edges(spark, folder, edges, nothing, stage):
    frame = edges.withColumn("n_chars", F.length("text"))
    assert stage[1](spark, frame, folder).count() > 0
    assert stage[1](spark, frame.where("false"), folder).count() == 0
