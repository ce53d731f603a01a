"""Segmentation of whole rasters by path or table, with files as results where wanted.

A raster argument is a Raster, a pixel table (r, c, bands), or a path (GeoTIFF by its ending, else a Parquet pixel table).
Segmenters return label tables (r, c, segment_id). output_file ends in .tif or is a Parquet path. A GeoTIFF of up to 2^26
pixels is the file that is named; a larger raster is a folder of blocks, named like it without the ending. block_nrows and overwrite are accepted where a reader or writer has
no use for them. All functions take the running session, or get one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import labels, regions, segment, tiles
from rasterloom.operators.segment import Segmenter
from rasterloom.plans.scale import broadcast_if_small, shared_dir, written
from rasterloom.sources import geotiff, tables


#: Pixels of a raster that is written as one GeoTIFF file.
SINGLE_FILE = 1 << 26


@dataclass
class Raster:
    """A pixel table with the raster's size."""

    px: DataFrame
    nrow: int
    ncol: int
    origin: tuple[float, float] = (0.0, 0.0)
    resolution: tuple[float, float] = (1.0, 1.0)
    crs: str = ""


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def rast(x: Raster | DataFrame | str) -> Raster:
    """The raster behind a path or table; a table's size is that of its largest row and column."""
    if isinstance(x, Raster):
        return x
    if isinstance(x, str) and x.lower().endswith((".tif", ".tiff")):
        m = geotiff.read_metadata(session(), x).first()
        if m is None:
            raise FileNotFoundError(x)
        px = written(tables.open_raster(session(), x), "raster")  # files are decoded once
        return Raster(px, m["nrow"], m["ncol"], (m["xmin"], m["ymax"]), (m["xres"], m["yres"]), m["crs"])
    if not isinstance(x, (str, DataFrame)):
        raise TypeError("a raster is a Raster, a pixel table or a path")
    px = tables.open_raster(session(), x)
    top = px.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    if top["r"] is None:
        raise ValueError("the raster has no pixels")
    return Raster(px, top["r"] + 1, top["c"] + 1)


def save(seg: DataFrame, x: Raster, output_file: str | None) -> DataFrame:
    """Writes labels if a file is named, and returns what was written."""
    if output_file is None:
        return seg
    seg = written(seg, "labels")  # the kernels run once
    if output_file.lower().endswith((".tif", ".tiff")):
        single = x.nrow * x.ncol <= SINGLE_FILE
        encoded = geotiff.encode_labels(seg, x.nrow, x.ncol, x.nrow if single else 512, origin=x.origin, resolution=x.resolution, crs=x.crs)
        geotiff.write_geotiff(encoded, output_file if single else output_file.rpartition(".")[0])
    else:
        tables.write_raster(seg, output_file)
    return seg


def report(seg: DataFrame, verbose: bool) -> DataFrame:
    if verbose:
        s = regions.segment_summary(seg).first()
        print(f"{s['n_segments']} segments, {s['avg_size']:.1f} pixels on average")
    return seg


def finish(seg: DataFrame, x: Raster, output_file: str | None, verbose: bool) -> DataFrame:
    return report(save(written(seg, "labels") if verbose else seg, x, output_file), verbose)


def fh_segmenter(x, k: float = 1.0, min_size: int = 50, eight: bool = True, scale_bands: bool = True, smooth: int = 0, output_file: str | None = None, verbose: bool = True) -> DataFrame:
    x = rast(x)
    return finish(segment.fh_segmenter(x.px, x.nrow, x.ncol, k, min_size, eight, scale_bands, smooth), x, output_file, verbose)


def fh_meanshift_segmenter(
    x, scale_bands: bool = True, smooth: int = 3, fh_k: float = 0.5, fh_min_size: int = 20, eight: bool = True, ms_dim: int = 0, ms_ranger: float = 0.15, ms_hs: float = 12, ms_max_iter: int = 10,
    ms_eps: float = 1e-3, mode_merge: float = 0.6, final_min_size: int = 80, output_file: str | None = None, verbose: bool = True,
) -> DataFrame:
    x = rast(x)
    args = {"fh_k": fh_k, "fh_min_size": fh_min_size, "eight": eight, "ms_dim": ms_dim, "ms_ranger": ms_ranger, "ms_hs": ms_hs, "ms_max_iter": ms_max_iter, "ms_eps": ms_eps, "mode_merge": mode_merge, "final_min_size": final_min_size}
    return finish(segment.hybrid_segmenter(x.px, x.nrow, x.ncol, scale_bands, smooth, **args), x, output_file, verbose)


def meanshift_segmenter(
    x, spatialr: int = 5, ranger: float = 1.0, max_iter: int = 10, eps: float = 1e-3, merge_thr: float | None = None, min_size: int = 30, eight: bool = True, scale_bands: bool = True, smooth: int = 0,
    return_filtered: bool = False, output_file: str | None = None, verbose: bool = True,
):
    """Labels, or (labels, filtered pixel table) with return_filtered."""
    x = rast(x)
    args = {"spatialr": spatialr, "ranger": ranger, "max_iter": max_iter, "eps": eps, "merge_thr": merge_thr, "min_size": min_size, "eight": eight}
    out = segment.meanshift_segmenter(x.px, x.nrow, x.ncol, scale_bands, smooth, return_filtered, **args)
    if not return_filtered:
        return finish(out, x, output_file, verbose)
    both = written(out, "filtered")
    return finish(both.select("r", "c", "segment_id"), x, output_file, verbose), both.select("r", "c", F.col("filtered").alias("bands"))


def baatz_segmenter(x, scale_param: float = 50, color_weight: float = 0.9, compactness: float = 0.5, band_weights=None, smooth: int = 0, output_file: str | None = None, verbose: bool = True) -> DataFrame:
    x = rast(x)
    args = {"scale_param": scale_param, "color_weight": color_weight, "compactness": compactness, "band_weights": band_weights}
    return finish(segment.baatz_segmenter(x.px, x.nrow, x.ncol, smooth, **args), x, output_file, verbose)


def baatz_fast_segmenter(x, scale_param: float = 50, color_weight: float = 0.9, compactness: float = 0.5, band_weights=None, smooth: int = 0, output_file: str | None = None, verbose: bool = False) -> DataFrame:
    x = rast(x)
    args = {"scale_param": scale_param, "color_weight": color_weight, "compactness": compactness, "band_weights": band_weights}
    return finish(segment.baatz_fast_segmenter(x.px, x.nrow, x.ncol, smooth, **args), x, output_file, verbose)


def seeds_segmenter(x, step: int = 10, nbins: int = 20, block_sizes=(8, 4, 2, 1), iters_per_level: int = 5, boundary_samples: int = 8, alpha: float = 1.0, smooth: int = 0, output_file: str | None = None, verbose: bool = False) -> DataFrame:
    x = rast(x)
    args = {"step": step, "nbins": nbins, "block_sizes": tuple(block_sizes), "iters_per_level": iters_per_level, "boundary_samples": boundary_samples, "alpha": alpha}
    return finish(segment.seeds_segmenter(x.px, x.nrow, x.ncol, smooth, **args), x, output_file, verbose)


def make_tiles_disk(x, tile_size: int = 2048, buffer: int = 64, prefix: str = "tile", dir: str | None = None, overwrite: bool = True, verbose: bool = True) -> DataFrame:
    """Tiles as Parquet folders dir/prefix/tile_id=N, buffered pixels and all; returns the tiles with the column file. Empty tiles are
    left out. Without dir they are put into the shared folder. Tiles that are there already are an error without overwrite."""
    x = rast(x)
    folder = f"{(dir or f'{shared_dir(session())}/tiles-{uuid.uuid4().hex}').rstrip('/')}/{prefix}"
    dealt = tiles.assign_pixels(x.px, x.nrow, x.ncol, tile_size, buffer)
    tables.write_tiles(dealt, folder, overwrite=overwrite)
    there = session().read.parquet(folder).select(F.col("tile_id").cast("long")).distinct()
    meta = tiles.make_tiles(session(), x.nrow, x.ncol, tile_size, buffer).join(broadcast_if_small(there), "tile_id", "left_semi")
    meta = meta.withColumn("file", F.concat(F.lit(f"{folder}/tile_id="), F.col("tile_id").cast("string")))
    if verbose:
        print(f"{meta.count()} tiles in {folder}")
    return meta


def segment_tiles(tile_meta: DataFrame, segment_fun: Segmenter, seg_args: dict | None = None, out_dir: str | None = None, out_prefix: str = "seg", overwrite: bool = True, cleanup_tiles: bool = False, force_positive: bool = True, verbose: bool = True) -> DataFrame:
    """Segments the tiles of make_tiles_disk in parallel and numbers labels over all tiles: (tile_id, r, c, inner, segment_id), also as
    Parquet below out_dir/out_prefix if a folder is named. Failed tiles are named in a warning; if all fail, it raises.
    cleanup_tiles deletes the tiles of make_tiles_disk in the end."""
    limits = tile_meta.agg(F.max("r1_in").alias("nrow"), F.max("c1_in").alias("ncol"), F.max(F.expr("r1_in - r0_in")).alias("size"), F.max("buffer").alias("buffer"), F.min("file").alias("file")).first()
    size = max(limits["size"], tile_meta.agg(F.max(F.expr("c1_in - c0_in"))).first()[0])
    px = session().read.parquet(limits["file"].rpartition("/")[0])
    out = segment.segment_tiles(px.where("inner").select("r", "c", "bands"), limits["nrow"], limits["ncol"], segment_fun, seg_args, size, limits["buffer"])
    cut = written(out, "tiles")
    segment.report_failures(cut)
    out = tiles.make_global(cut.drop("error"))
    if out_dir:
        tables.write_tiles(out, f"{out_dir}/{out_prefix}", overwrite=overwrite)
        out = session().read.parquet(f"{out_dir}/{out_prefix}").withColumn("tile_id", F.col("tile_id").cast("long"))
    if cleanup_tiles:
        tables.delete(session(), limits["file"].rpartition("/")[0])
    if verbose:
        print(f"{out.select('segment_id').distinct().count()} labels")
    return out


def segment_means_from_tiles(img, seg_tiles: DataFrame, ids, block_nrows: int = 512) -> DataFrame:
    """(segment_id, mean) of the listed ids over their whole buffered tiles; null without pixels."""
    x = rast(img)
    wanted = ids if isinstance(ids, DataFrame) else session().createDataFrame([(int(i),) for i in ids], "segment_id long")
    from rasterloom.operators.prepare import n_bands

    return regions.segment_means(x.px, seg_tiles, n_bands(x.px), wanted)


def merge_by_adjacency(adj_pairs: DataFrame, means: DataFrame, thr: float) -> DataFrame:
    return labels.merge_by_adjacency(adj_pairs, means, thr)


def apply_merge_map(seg: DataFrame | str, map: DataFrame, out_file: str | None = None, block_nrows: int = 1024) -> DataFrame:
    table = tables.read_raster(session(), seg) if isinstance(seg, str) else seg
    out = labels.apply_merge_map(table, map)
    return save(out, _label_raster(out), out_file) if out_file else out


def relabel_segments_global(seg: DataFrame | str, out_file: str | None = None, block_nrows: int = 1024) -> DataFrame:
    table = tables.read_raster(session(), seg) if isinstance(seg, str) else seg
    if table.where("segment_id is not null").isEmpty():
        raise ValueError("no labels")
    out = labels.relabel_global(table)
    return save(out, _label_raster(out), out_file) if out_file else out


def _label_raster(seg: DataFrame) -> Raster:
    top = seg.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return Raster(seg, (top["r"] or 0) + 1, (top["c"] or 0) + 1)


def segmenter_tile_engine(
    x, segment_fun: Segmenter, seg_args: dict | None = None, tile_size: int = 2048, buffer: int = 64, seam_thr: float = 0.8, out_file: str | None = None, tile_dir: str | None = None, cleanup_tiles: bool = False,
    cleanup_seg_tiles: bool = False, scale_bands: bool = False, smooth: int = 0, verbose: bool = True, **options,
) -> DataFrame:
    """options as in operators.segment.tile_engine: seam_scope, mosaic_rule, seam_space, stats_scope. The tiles' labels are kept in
    tile_dir if one is named and cleanup_seg_tiles is off. Pixels are dealt to tiles without files, so cleanup_tiles has none to delete."""
    x = rast(x)
    return finish(segment.tile_engine(x.px, x.nrow, x.ncol, segment_fun, seg_args, tile_size, buffer, seam_thr, scale_bands, smooth, tile_dir=tile_dir, cleanup_seg_tiles=cleanup_seg_tiles, **options), x, out_file, verbose)


def fh_segmenter_tile(
    x, tile_size: int = 2048, buffer: int = 64, seam_thr: float = 0.7, out_file: str | None = None, tile_dir: str | None = None, cleanup_tiles: bool = False, cleanup_seg_tiles: bool = False, k: float = 1.0,
    min_size: int = 50, eight: bool = True, scale_bands: bool = True, smooth: int = 0, verbose: bool = True, **options,
) -> DataFrame:
    """Folders and options as in segmenter_tile_engine."""
    x = rast(x)
    return finish(segment.fh_segmenter_tile(x.px, x.nrow, x.ncol, tile_size, buffer, seam_thr, k, min_size, eight, scale_bands, smooth, tile_dir=tile_dir, cleanup_seg_tiles=cleanup_seg_tiles, **options), x, out_file, verbose)


def fh_meanshift_segmenter_tile(
    x, tile_size: int = 1536, buffer: int = 96, seam_thr: float = 0.8, out_file: str | None = None, tile_dir: str | None = None, cleanup_tiles: bool = False, cleanup_seg_tiles: bool = False,
    scale_bands: bool = True, smooth: int = 3, verbose: bool = True, **args,
) -> DataFrame:
    """args as in fh_meanshift_segmenter, ms_dim 3 if not given, and folders and options as in segmenter_tile_engine."""
    x = rast(x)
    return finish(segment.hybrid_segmenter_tile(x.px, x.nrow, x.ncol, tile_size, buffer, seam_thr, scale_bands, smooth, tile_dir=tile_dir, cleanup_seg_tiles=cleanup_seg_tiles, **args), x, out_file, verbose)


def sample_raster_path(folder: str | None = None, size: int = 250) -> str:
    """The path of a small three-band GeoTIFF of fields and noise, made by rule; in the shared folder if none is named."""
    rng = np.random.default_rng(42)
    r, c = np.divmod(np.arange(size * size), size)
    field = ((r + 7 * np.sin(c / 9)) // 25).astype(int) * 100 + (c + 5 * np.cos(r / 11)) // 30
    tone = rng.integers(30, 226, (3, int(field.max()) + 1))
    image = tone[:, field.astype(int)].reshape(3, size, size) + rng.normal(0, 6, (3, size, size))
    path = f"{(folder or shared_dir(session())).rstrip('/')}/sample_{size}.tif"
    geotiff.write_bytes(session(), path, geotiff.encode(np.clip(image, 0, 255).astype(np.uint8), (500_000.0, 6_600_000.0), (10.0, 10.0), crs="UTM 35N"))
    return path
