"""One query for each operator, on the whole of its table, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import conversations, decontam, langmodel, mixing, pii, quality, resampling, simhash, suffixes, tokencount, topk, toxicity, urlfilter
from tracemill.llm._shared import table

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT score
              FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op5_mixing": mixing.oracle(),
    "op6_url_lists": urlfilter.ORACLE,
}


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_of(table(spark, sf_dir, "documents"))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(urlfilter.dated_pages(pages), urlfilter.dated_list(pages))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated_bytes(table(spark, sf_dir, "documents")).drop("kept")


ALL = (
    op1_top_k, op2_toxicity, op3_simhash, op4_quality, op5_mixing, op6_url_lists, op7_lm_scores, op8_decontamination, op9_personal_data, op10_token_counts,
    op11_importance_resampling, op12_conversation_repair, op13_repeated_bytes,
)
QUERIES = {f.__name__: f for f in ALL}
