"""Texts of 10 MB of one letter, of spaces, of newlines and of "a ": every operator gives their rows."""

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import licenses, line_dedup, mixing, ordinal, packing, quality_rules, queries, sharding, simhash, toxicity

MB = 1_000_000
LONG = {1: ("x", 10 * MB), 2: (" ", 10 * MB), 3: ("\n", 10 * MB), 4: ("a ", 5 * MB)}


@pytest.fixture(scope="module")
def table(docs):
    rows = docs([(i, "", "s") for i in LONG] + [(i, f"a usual text with the number {i} and some more words in it", "s") for i in range(5, 40)])
    text = F.col("text")
    for i, (unit, n) in LONG.items():
        text = F.when(F.col("doc_id") == i, F.repeat(F.lit(unit), F.lit(n))).otherwise(text)
    return rows.withColumn("text", text).repartition(8, "doc_id")


def of(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.select("doc_id", *names).where("doc_id < 5").collect()}


def test_simhash(table):
    got = of(simhash.near_duplicates(table), "fingerprint", "component_id")
    assert got[2] == got[3] == ("0" * 16, 2) and got[1][1] == 1 and got[4][1] == 4
    assert {r["doc_id"] for r in simhash.keep_one(table).select("doc_id").collect() if r["doc_id"] < 5} == {1, 2, 4}


def test_sharding(table):
    assert {k: v[0] for k, v in of(sharding.digest(table), "size").items()} == {i: 10 * MB + 8 for i in LONG}


def test_mixing(table):
    assert {k: v[0] for k, v in of(mixing.taken(table), "size").items()} == {1: 1, 2: 0, 3: 0, 4: 5 * MB}


def test_toxicity(table, spark):
    labels = spark.range(5, 40).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert len(of(toxicity.score(table, labels), "score")) == 4


def test_line_dedup(table):
    assert {k: len(v[0]) for k, v in of(line_dedup.remove_boilerplate(table), "text").items()}[1] == 10 * MB


def test_quality_rules(table, spark):
    trusted = spark.range(5, 20).withColumnRenamed("id", "doc_id")
    got = of(quality_rules.annotate(table.select("doc_id", "text"), trusted), "n_words", "n_repeat_words", "kept")
    assert got == {1: (1, 0, False), 2: (0, 0, False), 3: (0, 0, False), 4: (5 * MB, 5 * MB, False)}


def test_packing(table):
    got = packing.pack(table, queries.tokenizer()).where("doc_id < 5").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    n = {r["doc_id"]: r["n"] for r in got}
    assert n[2] == 10 * MB + 1 and n[3] == 5 * MB + 1 and n[4] == 5 * MB + 2 and all(r["most"] == 2048 for r in got)


def test_licenses(table):
    assert of(licenses.scan_licenses(table), "n_words", "labels") == {1: (1, ""), 2: (0, ""), 3: (0, ""), 4: (5 * MB, "")}


def test_ordinal(table, spark):
    graded = spark.range(1, 40).selectExpr("id as doc_id", "cast(id % 3 as int) as grade")
    assert len(of(ordinal.score(table, ordinal.train(table, graded)), "score")) == 4
