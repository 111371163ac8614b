"""The registered queries of this subpackage.

Each applies its operator, with production parameters, to its whole table and
derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm import decontaminate, html, langid, lines, lm_score, packing, quality, simhash, token_files, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Where the public vocabulary lies; not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("score", 6).alias("score"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), byte_bpe())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


#: Every query against every row, scored in doubles that hold the integers exactly.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS pos, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.pos, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.pos <> b.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

#: Words by position, counts of n-grams over all documents and within each, and the longest that others have.
LM_SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS w3, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM documents)),
grams AS (
  SELECT doc_id, i, w3, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
own AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, w3) AS o1, count(*) OVER (PARTITION BY doc_id, w2, w3) AS o2, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS o3,
    count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS c1,
    CASE WHEN i > 0 THEN count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY doc_id, w2, w3) ELSE 0 END AS c2,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY doc_id, w1, w2, w3) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
  FROM grams),
before AS (
  SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM own WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
scored AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / b2) WHEN c2 > 0 THEN ln(c2::DOUBLE / b1) + ln(0.4::DOUBLE) * (i > 1)::INT
    WHEN c1 > 0 THEN ln(c1::DOUBLE / rest) + ln(0.4::DOUBLE) * least(i, 2) ELSE ln(1.0::DOUBLE / (rest + 1)) + ln(0.4::DOUBLE) * least(i, 2) END AS s FROM before)
SELECT d.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 6) AS log_score, round(avg(s), 6) AS score
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL knows neither the hashes, the tokenizer, the parser nor the learned models of the other queries."""
    return {"op2_exact_top_k": TOP_K_SQL, "op6_lm_score": LM_SQL}
