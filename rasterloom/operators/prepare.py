"""Rasters as pixel tables (r, c, bands), and what is done to them before segmentation.

A raster is one DataFrame with 0-based r and c and `bands`, an array of doubles; pixels that are missing are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.bands import bin_of, block, finite, valid
from rasterloom.plans.scale import with_row


def from_columns(table: DataFrame, bands: list[str]) -> DataFrame:
    """(r, c, bands) from a table with one column per band; values that aren't finite become null."""
    known = [F.when(finite(F.col(b).cast("double")), F.col(b).cast("double")) for b in bands]
    return table.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.array(*known).alias("bands"))


def to_columns(px: DataFrame, n: int, prefix: str = "b", places: int | None = None) -> DataFrame:
    """One column per band, b1 to bn, rounded if places is given."""
    one = lambda i: F.get("bands", F.lit(i)) if places is None else F.round(F.get("bands", F.lit(i)), places)
    return px.select(*[x for x in px.columns if x != "bands"], *[one(i).alias(f"{prefix}{i + 1}") for i in range(n)])


def rasterize(points: DataFrame, r: Column, c: Column, values: list[str]) -> DataFrame:
    """Means of the points in a cell by band, and their number n."""
    return points.groupBy(r.cast("int").alias("r"), c.cast("int").alias("c")).agg(F.array(*[F.avg(v) for v in values]).alias("bands"), F.count("*").alias("n"))


def n_bands(px: DataFrame) -> int:
    first = px.select(F.size("bands").alias("n")).first()
    return first["n"] if first else 0


def scan_window(px: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels with r0 <= r < r1 and c0 <= c < c1; the filter reaches a Parquet scan."""
    return px.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def valid_mask(px: DataFrame) -> DataFrame:
    return px.withColumn("valid", valid(F.col("bands")))


def na_count(px: DataFrame) -> DataFrame:
    """Pixels with any band missing."""
    return px.agg(F.count("*").alias("n_pixels"), F.coalesce(F.sum((~valid(F.col("bands"))).cast("long")), F.lit(0)).cast("long").alias("n_na"))


def band_stats(px: DataFrame) -> DataFrame:
    """(band from 1, n, mean, sd, min, max) without nulls; sd over n - 1."""
    x = px.select(F.posexplode("bands").alias("i", "x"))
    return x.groupBy((F.col("i") + 1).alias("band")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))


def per_band(px: DataFrame, n: int, **aggregates) -> DataFrame:
    """One row: an array over the bands for each named function of a column."""
    return px.agg(*[F.array(*[f(F.get("bands", F.lit(i))) for i in range(n)]).alias(k) for k, f in aggregates.items()])


def each_band(n: int, f) -> Column:
    """An array of f(band, its number as a column): plain expressions, which stay inside generated code as a lambda wouldn't."""
    return F.array(*[f(F.get("bands", F.lit(i)), F.lit(i)) for i in range(n)])


def zscore_bands(px: DataFrame, n: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sd by band, sd over n - 1; an sd that is 0 or missing counts as 1. stats: of another table, with arrays mu and sd."""
    n = n or n_bands(px)
    stats = per_band(px, n, mu=F.avg, sd=F.stddev_samp) if stats is None else stats
    scaled = each_band(n, lambda x, i: (x - F.get("mu", i)) / F.coalesce(F.nullif(F.get("sd", i), F.lit(0.0)), F.lit(1.0)))
    return with_row(px, stats).withColumn("bands", scaled).drop("mu", "sd")


def fill_na_band_mean(px: DataFrame, n: int | None = None) -> DataFrame:
    """Missing values become their band's mean."""
    n = n or n_bands(px)
    filled = each_band(n, lambda x, i: F.coalesce(x, F.get("mu", i)))
    return with_row(px, per_band(px, n, mu=F.avg)).withColumn("bands", filled).drop("mu")


def band_subset(px: DataFrame, n: int) -> DataFrame:
    return px.withColumn("bands", F.slice("bands", 1, n))


def smooth_mean(px: DataFrame, size: int = 3, edge: str = "null", n: int | None = None) -> DataFrame:
    """Mean over a size x size window, by band, in two passes: along rows, then along columns.

    edge="null": a window that isn't all there gives null. edge="shrink": the mean of what is there. A null centre stays null.
    """
    if size % 2 == 0 or size < 1:
        raise ValueError("size must be odd and positive")
    if size == 1:
        return px
    n = n or n_bands(px)
    half = size // 2
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-half, half)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-half, half)
    t = px.select("r", "c", "bands", *[F.get("bands", F.lit(i)).alias(f"x{i}") for i in range(n)])
    t = t.select("r", "c", "bands", *[f(f"x{i}").over(along).alias(f"{k}{i}") for i in range(n) for k, f in (("s", F.sum), ("k", F.count))])
    t = t.select("r", "c", "bands", *[F.sum(f"{k}{i}").over(down).alias(f"{k}{i}") for i in range(n) for k in ("s", "k")])
    whole = lambda i: F.col(f"k{i}") == size * size if edge == "null" else F.col(f"k{i}") > 0
    mean = [F.when(F.get("bands", F.lit(i)).isNotNull() & whole(i), F.col(f"s{i}") / F.col(f"k{i}")) for i in range(n)]
    return t.select("r", "c", F.array(*mean).alias("bands"))


def quantize_bins(px: DataFrame, bins: int = 20, n: int | None = None) -> DataFrame:
    """qbins: each band in equal bins from its least to its greatest value; a flat band is bin 0."""
    n = n or n_bands(px)
    limits = per_band(px, n, lo=lambda x: F.coalesce(F.min(x), F.lit(0.0)), hi=lambda x: F.coalesce(F.max(x), F.lit(1.0)))
    top = lambda i: F.when(F.get("hi", i) > F.get("lo", i), F.get("hi", i)).otherwise(F.get("lo", i) + 1)
    q = each_band(n, lambda x, i: bin_of(x, F.get("lo", i), top(i), bins))
    return with_row(px, limits).withColumn("qbins", q).drop("lo", "hi")


def grid_init_labels(px: DataFrame, step: int, ncol: int) -> DataFrame:
    """label0: the step x step cell of a pixel, numbered from 0 along rows of cells."""
    return px.withColumn("label0", (block(F.col("r"), step) * F.lit(-(-ncol // step)) + block(F.col("c"), step)).cast("long"))


def align_resample(px: DataFrame, nrow: int, ncol: int, row_scale: float, col_scale: float, n: int | None = None) -> DataFrame:
    """Bilinear values on a grid of nrow x ncol cells whose centres are at row_scale, col_scale times the cell: each target reads the
    four source cells around its centre; cells that are missing are left out and the weights scaled up. A source cell finds its
    targets by arithmetic, so there is no join and no table of targets that Spark could take for small and broadcast."""
    n = n or n_bands(px)

    def reach(x: str, scale: float, cells: int) -> Column:
        """The targets whose centres may lie less than a cell from x."""
        first, last = F.greatest(F.lit(0), F.floor((F.col(x) - 0.5) / scale - 0.5)), F.least(F.lit(cells - 1), F.ceil((F.col(x) + 1.5) / scale - 0.5))
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))

    def weight(x: str, target: str, scale: float) -> Column:
        y = (F.col(target) + 0.5) * scale - 0.5
        return F.when(F.col(x) == F.floor(y), 1 - (y - F.floor(y))).when(F.col(x) == F.floor(y) + 1, y - F.floor(y)).otherwise(0.0)

    t = px.select(F.col("r").alias("sr"), F.col("c").alias("sc"), *[F.get("bands", F.lit(i)).alias(f"x{i}") for i in range(n)])
    t = t.withColumn("r", reach("sr", row_scale, nrow)).withColumn("wr", weight("sr", "r", row_scale)).where("wr > 0")
    t = t.withColumn("c", reach("sc", col_scale, ncol)).withColumn("w", F.col("wr") * weight("sc", "c", col_scale)).where("w > 0")
    mean = [F.sum(F.col("w") * F.col(f"x{i}")) / F.sum(F.when(F.col(f"x{i}").isNotNull(), F.col("w"))) for i in range(n)]
    return t.groupBy("r", "c").agg(F.array(*mean).alias("bands"))
