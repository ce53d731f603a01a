"""Rasters made from the star-schema tables, as Spark tables and as SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators.prepare import from_columns

EVENTS = """select cast((event_id - event_id % 100) / 100 as int) as r, cast(event_id % 100 as int) as c, event_type as et,
 value as v, cast(user_id as double) as u, cast(extract(hour from ts) as double) as h from events"""
SQL = {
    "px_events": f"select r, c, v as b1, u as b2, h as b3 from ({EVENTS}) e",
    "px_events_na": f"select r, c, case when et = 'error' then null else v end as b1, u as b2, h as b3 from ({EVENTS}) e",
    "px_orders": "select cast((o_orderkey - o_orderkey % 100) / 100 as int) as r, cast(o_orderkey % 100 as int) as c, o_totalprice as b1, cast(o_custkey as double) as b2 from orders",
    "seg_embed": "select cast((vec_id - vec_id % 25) / 25 as int) as r, cast(vec_id % 25 as int) as c, cast(label + 1 as bigint) as segment_id from embeddings",
    "seg_blocks": f"select r, c, cast(((r - r % 10) / 10) * 10 + (c - c % 10) / 10 + 1 as bigint) as segment_id from ({EVENTS}) e",
    "px_noise": """select cast(r as int) as r, cast(c as int) as c, cast((r*73856093 + c*19349663 + 83492791) % 1000003 % 256 as double) as b1,
 cast((r*73856093 + c*19349663 + 166985582) % 1000003 % 256 as double) as b2, cast((r*73856093 + c*19349663 + 250478373) % 1000003 % 256 as double) as b3
 from (select cast((event_id - event_id % 100) / 100 as bigint) as r, event_id % 100 as c from events) t""",
}
SQL["px_shapes"] = f"""select n.r, n.c, s.segment_id * 20 + n.b1 / 32 as b1, (s.segment_id * 37) % 256 + n.b2 / 32 as b2, (s.segment_id * 91) % 256 + n.b3 / 32 as b3
 from ({SQL["px_noise"]}) n join ({SQL["seg_blocks"]}) s on n.r = s.r and n.c = s.c"""
BANDS = {"px_events": 3, "px_events_na": 3, "px_orders": 2, "px_noise": 3, "px_shapes": 3}
TABLES = ("events", "orders", "embeddings", "lineitem")
WIDTH = {"seg_embed": 25}


def columns(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture with one column per band."""
    text = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"from {t}" in text}
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **tables)


def raster(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(r, c, bands)."""
    return from_columns(columns(spark, sf_dir, name), [f"b{i + 1}" for i in range(BANDS[name])])


def labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(r, c, segment_id)."""
    return columns(spark, sf_dir, name)


def n_rows(table: DataFrame) -> int:
    top = table.agg({"r": "max"}).first()[0]
    return 0 if top is None else top + 1
