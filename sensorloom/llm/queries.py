"""Queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .chroma import match_recordings
from .common import table
from .langid import identify_language, train_language_model
from .lexical import LEXICAL_SQL, search_documents
from .license import license_sql, scan_licenses
from .mixing import TARGETS, mixing_rates
from .packing import pack
from .passages import remove_passages
from .pii import find_personal_data
from .prefix_trie import conversation_trie, trie_sql
from .sharding import interleave_sql, shard_documents
from .simhash import near_duplicates
from .topk import top_k
from .toxicity import held_out, score_toxicity, train_toxicity


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(~held_out("doc_id", 5, 0)))
    return identify_language(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so every whole text's UTF-8 bytes are taken as 8-bit PCM."""
    return match_recordings(table(spark, sf_dir, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS pcm"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents; nulls, empty texts, ties and repeated rows as in search_documents."""
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of the law `rows`; nulls, empty texts, ties and repeated rows as in shard_documents."""
    dealt = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; nulls, empty texts, ties and repeated rows as in conversation_trie."""
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_license_scan": op1_license_scan, "op2_language_id": op2_language_id, "op3_simhash": op3_simhash, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_passages": op6_passages, "op7_topk": op7_topk, "op8_chroma": op8_chroma, "op9_personal_data": op9_personal_data, "op10_pack": op10_pack, "op11_lexical": op11_lexical, "op12_interleave": op12_interleave, "op13_prefix_trie": op13_prefix_trie, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op7_topk": TOPK_SQL, "op11_lexical": LEXICAL_SQL, "op12_interleave": interleave_sql(), "op13_prefix_trie": trie_sql()}
