"""Pixel and label tables as Parquet: the form in which rasters are kept and exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_raster(table: DataFrame, path: str, block: int = 512, codec: str = "zstd") -> None:
    """Sorted by blocks of rows and columns, so that a window's filter on r and c skips row groups."""
    placed = table.withColumns({"__i": F.floor(F.col("r") / block), "__j": F.floor(F.col("c") / block)})
    placed.repartition("__i", "__j").sortWithinPartitions("__i", "__j", "r", "c").drop("__i", "__j").write.mode("overwrite").option("compression", codec).parquet(path)


def write_tiles(tiled: DataFrame, path: str, codec: str = "zstd", overwrite: bool = True) -> None:
    """One folder per tile_id; tiles that are there already are replaced, or are an error without overwrite."""
    tiled.repartition("tile_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("tile_id").option("compression", codec).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def open_raster(spark: SparkSession, raster: str | DataFrame) -> DataFrame:
    """A pixel table as it is, or read from a path: a GeoTIFF by its ending, else Parquet."""
    if isinstance(raster, DataFrame):
        return raster
    if raster.lower().endswith((".tif", ".tiff")):
        from rasterloom.sources.geotiff import read_geotiff

        return read_geotiff(spark, raster).drop("path")
    return read_raster(spark, raster)
