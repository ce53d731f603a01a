"""Cross-site boilerplate lines by the number of distinct sites that have them.

A line is a \\n-split part of a text without surrounding white space; blank lines don't count. Lines are known by 128 bits of
hash. Each line gets a HyperLogLog sketch of its sites, merged map-side and after the shuffle, so a line that stands in
a third of all documents still travels as one sketch per task. Only lines whose estimate is near the threshold are
counted exactly. A line at `min_sites` or more sites is boilerplate: it stays where it stands first (smallest doc_id,
then place) and goes elsewhere.

Defined results: a null source is one site; a null text has no lines and stays null; null ids come last; rows that repeat a
doc_id and text are treated alike; a text may become empty, its row stays; an empty table gives an empty table; further
columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.quality_rules import let
from rasterloom.llm.text import SPACES
from rasterloom.plans.scale import Written, broadcast_if_small

MIN_SITES = 5
LG_K = 10


def place() -> Column:
    """Orders occurrences of a line; null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__h").alias("h"), F.col("pos"))


def line_table(docs: DataFrame, site_col: str = "source") -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.xxhash64(F.lit("site"), F.col(site_col)).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line <> ''")
    return bare.select("doc_id", "__h", "site", "pos", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("second"), F.col("line")).alias("l2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(l1, l2, first): lines at min_sites or more distinct sites, and the place that keeps them."""
    sketched = lines.groupBy("l1", "l2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(place()).alias("first"))
    spread = sketched.select("l1", "l2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, 3 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    likely = Written(spread.where(F.col("sites") >= min_sites - margin), "lines-likely").df
    near = broadcast_if_small(likely.where(F.col("sites") <= min_sites + margin).select("l1", "l2"))
    exact = lines.join(near, ["l1", "l2"], "left_semi").select("l1", "l2", "site").distinct()
    exact = exact.groupBy("l1", "l2").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    sure = likely.where(F.col("sites") > min_sites + margin).select("l1", "l2", "first")
    return sure.unionByName(likely.join(exact, ["l1", "l2"]).select("l1", "l2", "first"))


def removed_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(doc_id, __h, removed): places of the lines that go, by document."""
    lines = line_table(docs, site_col)
    found = Written(boilerplate(lines, min_sites, lg_k), "lines-found").df
    hits = lines.join(broadcast_if_small(found), ["l1", "l2"]).where(place() != F.col("first"))
    return hits.groupBy("doc_id", "__h").agg(F.collect_set("pos").alias("removed"))


def remove_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with text without its boilerplate lines, and n_removed_lines. Other lines stay as they are."""
    removed = Written(removed_lines(docs, site_col, min_sites, lg_k), "lines-removed").df
    right = removed.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__g"), F.col("removed").alias("__removed"))
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    joined = keyed.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    out = joined.withColumn("text", text).withColumn("n_removed_lines", F.coalesce(F.size("__removed"), F.lit(0)).cast("long"))
    return out.withColumn("n_removed_lines", F.greatest("n_removed_lines", F.lit(0).cast("long"))).drop("__h", "__d", "__g", "__removed")


def sql(min_sites: int = MIN_SITES) -> str:
    """The query op5 in DuckDB's SQL."""
    bare = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
with split as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents),
bare as (select doc_id, source, line, pos, {bare} as body from split),
spread as (
  select body, min(struct_pack(d := doc_id, p := pos)) as first from bare where body <> ''
  group by body having count(distinct coalesce('s' || source, 'null')) >= {min_sites}),
kept as (
  select b.doc_id, b.pos, b.line, s.body is not null and not (s.first.d = b.doc_id and s.first.p = b.pos) as gone
  from bare b left join spread s on b.body = s.body),
again as (
  select doc_id, coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '') as text,
         cast(sum(case when gone then 1 else 0 end) as bigint) as n_removed_lines
  from kept group by doc_id)
select d.doc_id, coalesce(a.n_removed_lines, 0) as n_removed_lines, a.text
from documents d left join again a on d.doc_id = a.doc_id
"""
