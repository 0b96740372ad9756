"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next
stage's documents. Quality and language drop the documents they reject, the two deduplications
keep one document of each group, and the last stage packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bloom_dedup, language, lsh_forest, packing, quality
from riskloom.llm.frames import located, packed, place, unpacked
from riskloom.session import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those whose language stays below one half, and those
    less likely, by n-gram, than documents of their language are (other languages, gibberish).

    Where no document to learn from has a language, all with a letter stay.
    """
    known = language.trained_on(docs)
    model = language.learn(known)
    return language.in_languages(docs, model, language.floors(known, model))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_groups(docs).where("kept").select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = located(docs)
    dropped = settle(lsh_forest.near_links(docs).where("NOT kept").select("place"))
    rows = bloom_dedup.possible_members(packed(docs, place=place(docs)), dropped, ["place"])
    stays = rows.where("maybe").join(dropped, "place", "left_anti").select("row").unionByName(rows.where("NOT maybe").select("row"))
    return unpacked(stays, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifiers, the similarity and the packing have none; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
