"""Tiles with a buffer around them, and putting segmented tiles together.

Rows and columns are 0-based and windows half-open. A tile's inner window is tile_size x tile_size, cut at the raster's
edge; its buffered window reaches `buffer` further, cut likewise. Tiles are numbered along rows of tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators.adjacency import FORWARD, shifted


def grid_shape(nrow: int, ncol: int, tile_size: int) -> tuple[int, int]:
    if nrow < 1 or ncol < 1 or tile_size < 1:
        raise ValueError("a raster and its tiles need at least one row and column")
    return -(-nrow // tile_size), -(-ncol // tile_size)


def make_tiles(spark: SparkSession, nrow: int, ncol: int, tile_size: int = 2048, buffer: int = 64) -> DataFrame:
    """(tile_id, r0_in, r1_in, c0_in, c1_in, r0_buf, r1_buf, c0_buf, c1_buf, buffer)."""
    down, across = grid_shape(nrow, ncol, tile_size)
    t = spark.range(down * across).select(F.col("id").alias("tile_id"), F.floor(F.col("id") / across).alias("i"), F.pmod("id", F.lit(across)).alias("j"))
    t = t.select("tile_id", (F.col("i") * tile_size).alias("r0_in"), F.least((F.col("i") + 1) * tile_size, F.lit(nrow)).alias("r1_in"), (F.col("j") * tile_size).alias("c0_in"), F.least((F.col("j") + 1) * tile_size, F.lit(ncol)).alias("c1_in"))
    t = t.withColumns({
        "r0_buf": F.greatest(F.col("r0_in") - buffer, F.lit(0)), "r1_buf": F.least(F.col("r1_in") + buffer, F.lit(nrow)),
        "c0_buf": F.greatest(F.col("c0_in") - buffer, F.lit(0)), "c1_buf": F.least(F.col("c1_in") + buffer, F.lit(ncol)),
    })
    whole = [c for c in t.columns if c != "tile_id"]
    return t.select("tile_id", *[F.col(c).cast("int") for c in whole], F.lit(buffer).alias("buffer"))


def owner(nrow: int, ncol: int, tile_size: int) -> Column:
    """The tile whose inner window has the pixel."""
    _, across = grid_shape(nrow, ncol, tile_size)
    return (F.floor(F.col("r") / tile_size) * across + F.floor(F.col("c") / tile_size)).cast("long")


def assign_pixels(px: DataFrame, nrow: int, ncol: int, tile_size: int, buffer: int) -> DataFrame:
    """px once per tile whose buffered window has the pixel, with tile_id and inner (whether its inner window has it). By arithmetic, without a join."""
    down, across = grid_shape(nrow, ncol, tile_size)

    def reach(x: str, last: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(x) - buffer) / tile_size))
        return F.explode(F.sequence(first, F.least(F.lit(last - 1), F.floor((F.col(x) + buffer) / tile_size))))

    t = px.withColumn("__i", reach("r", down)).withColumn("__j", reach("c", across))
    # the first tile of a sequence may end its buffer one pixel short
    t = t.where((F.col("r") < (F.col("__i") + 1) * tile_size + buffer) & (F.col("c") < (F.col("__j") + 1) * tile_size + buffer))
    t = t.withColumn("tile_id", (F.col("__i") * across + F.col("__j")).cast("long"))
    return t.withColumn("inner", F.col("tile_id") == owner(nrow, ncol, tile_size)).drop("__i", "__j")


def seam_predicate(seam_width: int) -> Column:
    """Whether a pixel of a tile (with the tile's columns) lies in the strips of seam_width just inside the inner window, which run
    through the buffer too; every pixel does if seam_width or the window leaves no strip."""
    strip = F.least(F.lit(seam_width), F.floor(F.least(F.col("r1_in") - F.col("r0_in"), F.col("c1_in") - F.col("c0_in")) / 2) - 1)

    def near(x: str) -> Column:
        lo, hi = F.col(f"{x}0_in"), F.col(f"{x}1_in")
        return ((F.col(x) >= lo) & (F.col(x) < lo + strip)) | ((F.col(x) >= hi - strip) & (F.col(x) < hi))

    return F.when((F.lit(seam_width) <= 0) | (strip < 1), F.lit(True)).otherwise(near("r") | near("c"))


def seam_mask(tiled: DataFrame, tiles: DataFrame, seam_width: int) -> DataFrame:
    """tiled (tile_id, r, c, ...) with `seam`."""
    inner = tiles.select("tile_id", "r0_in", "r1_in", "c0_in", "c1_in")
    return tiled.join(inner, "tile_id").withColumn("seam", seam_predicate(seam_width)).drop("r0_in", "r1_in", "c0_in", "c1_in")


def seam_pairs(masked: DataFrame, eight: bool = True) -> DataFrame:
    """(a, b): different labels that touch inside one tile where either pixel is on a seam; masked: (tile_id, r, c, segment_id, seam)."""
    t = masked.where("segment_id is not null").select("tile_id", "r", "c", "segment_id", "seam")
    first = t.select("tile_id", "r", "c", F.col("segment_id").alias("x"), F.col("seam").alias("s"))
    pairs = shifted(first, FORWARD[: 4 if eight else 2], [F.col("tile_id"), F.col("x"), F.col("s")]).join(t, ["tile_id", "r", "c"])
    pairs = pairs.where("x <> segment_id and (s or seam)")
    return pairs.select(F.least("x", "segment_id").alias("a"), F.greatest("x", "segment_id").alias("b")).distinct()


def cross_tile_pairs(seg: DataFrame, nrow: int, ncol: int, tile_size: int, eight: bool = True, shift: int = 0) -> DataFrame:
    """(a, b): labels that touch across the border of two tiles; seg is the mosaic. Only border pixels are shuffled.

    shift: how far the borders lie before those of the inner windows: 0 in an inner mosaic, the buffer where the last tile wins.
    """
    down, across = grid_shape(nrow, ncol, tile_size)
    at = lambda x: F.col(x) + shift
    edge = lambda x: F.pmod(at(x), F.lit(tile_size)).isin(0, tile_size - 1)
    tile = F.least(F.floor(at("r") / tile_size), F.lit(down - 1)) * across + F.least(F.floor(at("c") / tile_size), F.lit(across - 1))
    t = seg.where("segment_id is not null").where(edge("r") | edge("c")).select("r", "c", "segment_id", tile.alias("t"))
    first = t.select("r", "c", F.col("segment_id").alias("x"), F.col("t").alias("tx"))
    pairs = shifted(first, FORWARD[: 4 if eight else 2], [F.col("x"), F.col("tx")]).join(t, ["r", "c"]).where("tx <> t and x <> segment_id")
    return pairs.select(F.least("x", "segment_id").alias("a"), F.greatest("x", "segment_id").alias("b")).distinct()


def global_id_offset(tiled: DataFrame) -> DataFrame:
    """(tile_id, max_label, offset): the sum of the largest labels of the tiles before; one row per tile, in one task."""
    top = tiled.groupBy("tile_id").agg(F.coalesce(F.max(F.when(F.col("segment_id") > 0, F.col("segment_id"))), F.lit(0)).cast("long").alias("max_label"))
    before = F.sum("max_label").over(Window.partitionBy(F.lit(0)).orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1))
    return top.select("tile_id", "max_label", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def make_global(tiled: DataFrame) -> DataFrame:
    """Labels of all tiles made different by the offsets; 0 and null stay."""
    shifted_by = global_id_offset(tiled).select("tile_id", "offset")
    t = tiled.join(shifted_by, "tile_id")
    return t.withColumn("segment_id", F.when(F.col("segment_id") > 0, F.col("segment_id") + F.col("offset")).otherwise(F.col("segment_id"))).drop("offset")


def mosaic(tiled: DataFrame, rule: str = "inner") -> DataFrame:
    """(r, c, segment_id) of the raster. inner: from the tile that owns the pixel; last_wins: from the last tile that has it."""
    if rule == "inner":
        return tiled.where("inner").select("r", "c", "segment_id")
    last = tiled.groupBy("r", "c").agg(F.max(F.struct("tile_id", "segment_id")).alias("m"))
    return last.select("r", "c", F.col("m.segment_id").alias("segment_id"))
