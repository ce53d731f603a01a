"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one reads; run() writes every stage's rows as
Parquet below spark.checkpoint.dir and reads them again. The last stage returns packed pieces with their token ids, all others the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import line_dedup, mixing, packing, quality_rules, simhash
from rasterloom.llm.queries import tokenizer, trusted
from rasterloom.plans.scale import Written

SEQUENCE = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, trusted(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, errors=3, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, share=1.5, cap=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer(), length=SEQUENCE, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Hashes (XXH64), sketches and the tokenizer can't be written in DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Written(stage(spark, docs, sf_dir), f"stage-{name}").df
    return docs
