"""The registered queries: each operator over the whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bloom_dedup, fim_frames, interpolation, language, lsh_forest, merkle, packing, piece_lattice, quality, sharding, token_counts, toxicity, weighted_sampling
from riskloom.llm.frames import remainder


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = documents(spark, folder).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return sharding.shard(digests).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_sampling.compare_edited(documents(spark, folder))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_lattice.encode(documents(spark, folder), results=piece_lattice.digest_results(), schema=piece_lattice.DIGESTS)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return lsh_forest.near_links(docs).select(F.col("k").alias("doc_id"), *lsh_forest.RESULTS)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality.classify(docs, model).select("doc_id", "source", "lang", *quality.RESULTS)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_dedup.exact_groups(documents(spark, folder)).select("doc_id", *bloom_dedup.RESULTS)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder)).select("doc_id", *token_counts.RESULTS)


def op9_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score(documents(spark, folder))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = language.identify(docs, language.learn(language.trained_on(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    altered = F.when(tampered, F.regexp_replace(docs["text"], "\n", "")).otherwise(docs["text"])
    built = merkle.manifest(docs, altered)
    return built.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder(labels["doc_id"], 3) != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_end", "worst_score",
    )


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = fim_frames.fim_documents(documents(spark, folder))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_interpolation": op9_interpolation,
    "op10_language": op10_language,
    "op11_manifest": op11_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op7_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha
      FROM documents)
WINDOW same AS (PARTITION BY sha)
""",
    "op13_fill_in_middle": """
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx
    FROM documents),
counted AS (
    SELECT *, CAST(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND NOT ends_with(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n
    FROM base),
hashed AS (
    SELECT *,
           CAST(('0x' || substr(hx, 1, 8)) AS UBIGINT) % (n + 1) AS c1,
           CAST(('0x' || substr(hx, 9, 8)) AS UBIGINT) % (n + 1) AS c2,
           CAST(('0x' || substr(hx, 17, 8)) AS UBIGINT) % 100 AS h3,
           CAST(('0x' || substr(hx, 25, 8)) AS UBIGINT) % 100 AS h4
    FROM counted),
formed AS (
    SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
                WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
           string_split(t, chr(10)) AS parts
    FROM hashed),
cut AS (
    SELECT *,
           CAST(coalesce(list_sum(list_transform(list_slice(parts, 1, a), lambda x: length(x) + 1)), 0)
             - CASE WHEN a = n AND n > 0 AND NOT ends_with(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS x,
           CAST(coalesce(list_sum(list_transform(list_slice(parts, 1, b), lambda x: length(x) + 1)), 0)
             - CASE WHEN b = n AND n > 0 AND NOT ends_with(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS y
    FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(x AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(y - x AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, x) || '<S>' || substr(t, y + 1) || '<M>' || substr(t, x + 1, y - x)
                        ELSE '<S>' || substr(t, y + 1) || '<P>' || substr(t, 1, x) || '<M>' || substr(t, x + 1, y - x) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
""",
}
