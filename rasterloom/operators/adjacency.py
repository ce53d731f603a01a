"""Neighbouring pixels and neighbouring regions.

Each pair is built once, from the pixel above or to the left, so one side of the join carries 2 or 4 shifted copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.bands import distance32, squared_distance, valid

#: Right, down, down-right, down-left.
FORWARD = [(0, 1), (1, 0), (1, 1), (1, -1)]


def shifted(table: DataFrame, offsets: list[tuple[int, int]], carry: list[Column]) -> DataFrame:
    """A copy of each row per offset, placed on the neighbour's r and c, with its own r and c as ar, ac."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(i).cast("byte").alias("dir")) for i, (dr, dc) in enumerate(offsets)])
    t = table.select(F.col("r").alias("ar"), F.col("c").alias("ac"), *carry, F.explode(steps).alias("o"))
    return t.withColumns({"r": F.col("ar") + F.col("o.dr"), "c": F.col("ac") + F.col("o.dc"), "dir": F.col("o.dir")}).drop("o")


def adjacency_edges(px: DataFrame, ncol: int, eight: bool = True) -> DataFrame:
    """(a, b, dir): neighbouring valid pixels by cell number r * ncol + c, a before b."""
    ok = px.where(valid(F.col("bands"))).select("r", "c")
    pairs = shifted(ok, FORWARD[: 4 if eight else 2], []).join(ok, ["r", "c"])
    cell = lambda r, c: (F.col(r).cast("long") * ncol + F.col(c)).alias
    return pairs.select(cell("ar", "ac")("a"), cell("r", "c")("b"), "dir")


def edge_weights(px: DataFrame, ncol: int, eight: bool = True) -> DataFrame:
    """(a, b, dir, w): adjacency_edges with the float32 distance of the bands."""
    ok = px.where(valid(F.col("bands"))).select("r", "c", "bands")
    pairs = shifted(ok.withColumnRenamed("bands", "x"), FORWARD[: 4 if eight else 2], [F.col("x")]).join(ok, ["r", "c"])
    cell = lambda r, c: (F.col(r).cast("long") * ncol + F.col(c)).alias
    return pairs.select(cell("ar", "ac")("a"), cell("r", "c")("b"), "dir", distance32(F.col("x"), F.col("bands")).alias("w"))


def sort_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges by weight; a and b settle ties. limit: only the first ones, by a top-k instead of a whole sort."""
    ordered = edges.orderBy("w", "a", "b")
    return ordered if limit is None else ordered.limit(limit)


def neighbor_labels(seg: DataFrame, eight: bool = False, label: str = "segment_id") -> DataFrame:
    """(a, b) for every pair of neighbouring pixels with different labels, a < b, as often as they touch."""
    t = seg.where(F.col(label).isNotNull()).select("r", "c", F.col(label).alias("l"))
    pairs = shifted(t.withColumnRenamed("l", "x"), FORWARD[: 4 if eight else 2], [F.col("x")]).join(t, ["r", "c"]).where("x <> l")
    return pairs.select(F.least("x", "l").alias("a"), F.greatest("x", "l").alias("b"))


def region_adjacency(seg: DataFrame, eight: bool = True) -> DataFrame:
    return neighbor_labels(seg, eight).distinct()


def shared_boundary(seg: DataFrame) -> DataFrame:
    """(a, b, shared): pixel sides between two regions."""
    return neighbor_labels(seg, False).groupBy("a", "b").agg(F.count("*").alias("shared"))


def window_neighbors(radius: int, diagonal_rule: bool = True) -> list[tuple[int, int]]:
    """Offsets of a (2 radius + 1)^2 window but its centre; diagonal_rule=False also leaves out those with |dr| + |dc| = 2."""
    around = range(-radius, radius + 1)
    return [(i, j) for i in around for j in around if (i or j) and (diagonal_rule or abs(i) + abs(j) != 2)]


def ms_filter_step(px: DataFrame, radius: int = 1, ranger: float = 1.0, eight: bool = True, n: int = 1) -> DataFrame:
    """One mean-shift step from each valid pixel's own value over its window; weights below 1e-6 count as 0."""
    import math

    sigma = max(1.0, radius / 2)
    offsets = window_neighbors(radius, eight)
    ws = F.array(*[F.lit(math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i, j in offsets])
    ok = px.where(valid(F.col("bands"))).select("r", "c", "bands")
    reached = shifted(ok.withColumnRenamed("bands", "x"), [(-i, -j) for i, j in offsets], [F.col("x")]).withColumn("ws", F.get(ws, F.col("dir").cast("int")))
    met = reached.join(ok, ["r", "c"])
    w = F.col("ws") * F.exp(-squared_distance(F.col("x"), F.col("bands")) / (2 * ranger * ranger))
    met = met.withColumn("w", w).where("w >= 1e-6")
    sums = met.groupBy("r", "c").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(n)])
    out = ok.join(sums, ["r", "c"], "left")
    new = [(F.get("bands", F.lit(i)) + F.coalesce(F.col(f"s{i}"), F.lit(0.0))) / (1 + F.coalesce("w", F.lit(0.0))) for i in range(n)]
    return out.select("r", "c", F.array(*new).alias("bands"))


def first_differing_neighbor(seg: DataFrame, label: str = "segment_id") -> DataFrame:
    """(r, c, segment_id, other): the first different label in the order right, left, down, up."""
    along, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    at = lambda f, w, axis, step: F.when(f(axis).over(w) == F.col(axis) + step, f(label).over(w))
    t = seg.withColumns({"right": at(F.lead, along, "c", 1), "left": at(F.lag, along, "c", -1)})
    t = t.withColumns({"down": at(F.lead, down, "r", 1), "up": at(F.lag, down, "r", -1)})
    differing = [F.when(F.col(x) != F.col(label), F.col(x)) for x in ("right", "left", "down", "up")]
    return t.select("r", "c", label, F.coalesce(*differing).alias("other"))
