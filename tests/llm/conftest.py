import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def docs(spark):
    """make(rows of (doc_id, text) or (doc_id, text, source), extra={name: value}) -> documents"""

    def make(rows, extra=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        from pyspark.sql import functions as F

        out = spark.createDataFrame(full, SCHEMA)
        for name, value in (extra or {}).items():
            out = out.withColumn(name, F.lit(value))
        return out

    return make


#: Rows with all that an operator must stand: nulls, empty and very long texts, repeated rows.
HARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (2, None, "a"),
    (3, "", None),
    (None, "a text without an id but with some words in it, ten at least", "b"),
    (None, None, None),
    (4, " \t\n ", "b"),
    (5, "word " * 30_000, "b"),
    (6, "x" * 100_000, "c"),
    (7, "Ünïcode ß 東京 😀 text\x0bwith\x0codd spaces here and\r\nlines", "c"),
]
#: Names that operators use inside or give to their results.
CLASH = {"fp": 1, "size": 2, "score": 3, "rank": 4, "rows": 5, "target": 6, "line": 7, "pos": 8, "label": 9, "grp": 10, "level": 11, "first": 12, "bucket": 13, "kept": 14, "shard": 15}


@pytest.fixture(scope="session")
def hard():
    return HARD


@pytest.fixture(scope="session")
def clash():
    return CLASH
