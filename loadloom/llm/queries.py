"""The queries of this subpackage: every operator bound to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.llm import (decontaminate, embedding_dedup, hard_negatives, language_id, licenses, lm_score, packing, sharding, simhash, substring, tokens, toxicity,
                          vector_codes)
from loadloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), sharding.balanced_tree(24), sharding.balanced_tree(25))


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


@query
def op3_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_words(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(read(spark, sf_dir, "embeddings"))


@query
def op5_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


@query
def op8_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as source/lang/hundreds/id; every hundredth is its folder's licence file, every thousandth its parent's."""
    folder = F.concat_ws("/", "source", "lang")
    block = F.floor(F.col("doc_id") / 100).cast("string")
    path = (F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", folder, F.lit("LICENSE")))
            .when(F.col("doc_id") % 100 == 0, F.concat_ws("/", folder, block, F.lit("LICENSE")))
            .otherwise(F.concat_ws("/", folder, block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))
    return licenses.scan(read(spark, sf_dir, "documents").withColumn("path", path))


@query
def op10_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(read(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read(spark, sf_dir, "embeddings"))


ORACLE["op11_vector_codes"] = vector_codes.encode_sql()


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE["op13_hard_negatives"] = hard_negatives.MINE_SQL
