"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import licenses, line_dedup, mixing, ordinal, packing, quality_rules, sharding, simhash, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), errors=3, words=3).drop("links_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), n_shards=24)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), share=1.5, cap=2.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=line_dedup.MIN_SITES).select("doc_id", "n_removed_lines", "text")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality_rules.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted(spark, sf_dir))
    return marked.drop("text")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), length=2048)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.self_search(table(spark, sf_dir, "embeddings"), every=50, k=10)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on rows whose crc32(doc_id as text) mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    graded = ordinal.rated(table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 3 <> 1"))
    return ordinal.score(docs, ordinal.train(docs, graded))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_ordinal": op10_ordinal,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.sql(),
    "op8_topk": topk.sql(),
}
