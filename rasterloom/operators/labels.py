"""Changing labels: lookups, merging by adjacency and consecutive numbers. Labels are longs; null is no label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.bands import squared_distance
from rasterloom.operators.components import connected_components
from rasterloom.plans.scale import broadcast_if_small, written


def apply_merge_map(seg: DataFrame, mapping: DataFrame) -> DataFrame:
    """seg with new_id where mapping (old_id, new_id) has its label; one step, other labels unchanged."""
    m = written(mapping.select(F.col("old_id").alias("__o"), F.col("new_id").alias("__n")), "merge-map")  # counted, then joined
    return seg.join(broadcast_if_small(m), F.col("segment_id") == F.col("__o"), "left").withColumn("segment_id", F.coalesce("__n", "segment_id")).drop("__o", "__n")


def invalid_to_null(seg: DataFrame) -> DataFrame:
    return seg.withColumn("segment_id", F.nullif("segment_id", F.lit(0).cast("long")))


def ranked(ids: DataFrame, order: str, per_range: int = 1 << 18) -> DataFrame:
    """ids with `rank`, 1 to their number by `order` (unique longs), without sorting all in one task: values are cut into ranges of
    about per_range rows at their quantiles, wherever they lie, ranked inside a range and shifted by the ranges before it."""
    ids = written(ids, "rank-ids")
    ranges = min(4096, -(-ids.count() // per_range))
    if ranges > 1:
        bounds = sorted(set(ids.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))  # at most 4,095
        t = ids.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(order))))
    else:
        t = ids.withColumn("__b", F.lit(0))
    sizes = t.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("__before"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(order))
    return t.withColumn("__r", inside).join(F.broadcast(offsets), "__b").withColumn("rank", (F.col("__before") + F.col("__r")).cast("long")).drop("__b", "__r", "__before")


def relabel_global(seg: DataFrame) -> DataFrame:
    """Labels 1 to their number in the order of the old ones; the distinct labels are ranked, not the pixels."""
    ids = seg.where("segment_id is not null").select(F.col("segment_id").alias("old_id")).distinct()
    mapping = ranked(ids, "old_id").select("old_id", F.col("rank").alias("new_id"))
    return apply_merge_map(seg, mapping)


def relabel_first_seen(seg: DataFrame, ncol: int) -> DataFrame:
    """Labels 1 to their number in the order of their first pixel, row by row."""
    first = seg.where("segment_id is not null").groupBy(F.col("segment_id").alias("old_id")).agg(F.min(F.col("r").cast("long") * ncol + F.col("c")).alias("cell"))
    return apply_merge_map(seg, ranked(first, "cell").select("old_id", F.col("rank").alias("new_id")))


def merge_by_adjacency(pairs: DataFrame, means: DataFrame, threshold: float) -> DataFrame:
    """(old_id, new_id) for every id in pairs (a, b): ids joined over pairs whose means are less than threshold apart; new_id is the
    smallest of each. Pairs with a missing mean don't join; means: (segment_id, mean)."""
    a = means.select(F.col("segment_id").alias("a"), F.col("mean").alias("ma"))
    b = means.select(F.col("segment_id").alias("b"), F.col("mean").alias("mb"))
    d2 = squared_distance(F.col("ma"), F.col("mb"))
    close = pairs.join(a, "a").join(b, "b").where(d2.isNotNull() & ~F.isnan(d2) & (F.sqrt(d2) < threshold))
    found = connected_components(close.select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("old_id")).where("old_id is not null").distinct()
    return ids.join(found, F.col("old_id") == F.col("node"), "left").select("old_id", F.coalesce("component", "old_id").alias("new_id"))


def enforce_connectivity(seg: DataFrame, ncol: int, eight: bool = True) -> DataFrame:
    """Every part of a segment that doesn't hang together with the rest gets its own label."""
    from rasterloom.operators.regions import connected_parts

    parts = connected_parts(seg, eight)
    renamed = parts.select("r", "c", F.col("part").alias("segment_id"))
    return relabel_first_seen(renamed, ncol)
