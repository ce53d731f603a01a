"""Segmenters over pixel tables: a whole raster in one tile, or tile by tile with labels put together.

A segmenting function takes a dense block (band, row, column; NaN where a value is missing) and named arguments and returns
labels (row, column), 0 or below for none. The six kernels of rasterloom.kernels and any function of that form plug in.

Exact under tiling: smoothing, scaling, masks, mean-shift filtering (buffer of at least its radius), statistics, merging,
relabelling. Depend on the tiles: the graph-based and region-merging kernels, superpixels and all minimum sizes. One tile
for the whole raster (tile_size=None) is the mode without tiles; it runs in one task and its memory bounds the raster, but for
best-pair-first merging, which gets the same labels from windows.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.kernels.baatz import baatz_fast_segment, baatz_segment
from rasterloom.kernels.graph import fh_segment
from rasterloom.kernels.hybrid import hybrid_segment
from rasterloom.kernels.meanshift import meanshift_segment
from rasterloom.kernels.seeds import seeds_segment
from rasterloom.operators import labels, prepare, regions, tiles, windows
from rasterloom.plans.scale import Written, broadcast_if_small

Segmenter = Callable[..., np.ndarray]
KERNELS = (fh_segment, hybrid_segment, meanshift_segment, baatz_segment, baatz_fast_segment, seeds_segment)


def check_call(fun: Segmenter, args: dict, n: int) -> None:
    """Raises, before any Spark job, what a call with these arguments would raise: unknown or missing names for every function, and
    values out of range for the kernels, which are tried on a block of n bands and four pixels."""
    inspect.signature(fun).bind(None, **args)
    if fun in KERNELS:
        fun(np.zeros((n, 2, 2)), **args)


def scaled_block(block: np.ndarray) -> np.ndarray:
    """z-scores within a block, sd over n - 1; an sd that is 0 or missing counts as 1."""
    out = np.where(np.isfinite(block), block, np.nan)
    for band in out:
        x = band[~np.isnan(band)]
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        band -= x.mean() if len(x) else 0.0
        band /= sd if sd > 0 else 1.0
    return out


def segment_tiles(px: DataFrame, nrow: int, ncol: int, fun: Segmenter, args: dict | None = None, tile_size: int | None = None, buffer: int = 0, scale_tiles: bool = False, keep_buffer: bool = True, filtered: bool = False, n: int | None = None, strict: bool = False) -> DataFrame:
    """(tile_id, r, c, inner, segment_id, error [, filtered] [, raw]): each tile segmented by itself; labels are not yet unique over tiles.

    Arguments are checked first. A tile whose function fails has null labels and the error's text, and the others go on;
    with strict the job fails instead. keep_buffer=False leaves out pixels that another tile owns. filtered: fun returns
    (labels, bands). n: the number of bands, if it is known. A column raw of px is handed through.
    """
    n = n or prepare.n_bands(px)
    check_call(fun, dict(args or {}), n)
    raw = ["raw"] * ("raw" in px.columns)
    size = tile_size or max(nrow, ncol)
    down, across = tiles.grid_shape(nrow, ncol, size)
    args = dict(args or {})
    flat = px.select("r", "c", *raw, *[F.get("bands", F.lit(i)).alias(f"b{i}") for i in range(n)])
    dealt = tiles.assign_pixels(flat, nrow, ncol, size, buffer)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        i, j = divmod(tile, across)
        r0, r1 = max(0, i * size - buffer), min(nrow, min(nrow, (i + 1) * size) + buffer)
        c0, c1 = max(0, j * size - buffer), min(ncol, min(ncol, (j + 1) * size) + buffer)
        block = np.full((n, r1 - r0, c1 - c0), np.nan)
        r, c = t["r"].to_numpy() - r0, t["c"].to_numpy() - c0
        for k in range(n):
            block[k, r, c] = t[f"b{k}"].to_numpy()  # null is NaN
        error, bands = None, None
        try:
            got = fun(scaled_block(block) if scale_tiles else block, **args)
            got, bands = got if filtered else (got, None)
            got = np.asarray(got)
            label = (got if got.ndim == 2 else got[0])[r, c].astype(np.int64)  # the first layer of several
        except Exception as e:  # one tile's failure leaves the others
            if strict:
                raise
            error, label = f"{type(e).__name__}: {e}", np.zeros(len(t), np.int64)
        columns = {"tile_id": pa.array(np.full(len(t), tile)), "r": t["r"], "c": t["c"], "inner": t["inner"], "segment_id": pa.array(label, mask=label <= 0), "error": pa.array([error] * len(t), pa.string())}
        if filtered:
            columns["filtered"] = pa.array(list(bands[:, r, c].T) if bands is not None else [None] * len(t), pa.list_(pa.float64()))
        columns |= {name: t[name] for name in raw}
        out = pa.table(columns)
        return out if keep_buffer else out.filter(out["inner"])

    schema = "tile_id long, r int, c int, inner boolean, segment_id long, error string" + ", filtered array<double>" * filtered + ", raw array<double>" * len(raw)
    return dealt.groupBy("tile_id").applyInArrow(one, schema)


def failed_tiles(segmented: DataFrame) -> DataFrame:
    """(tile_id, error) of the tiles whose function failed."""
    return segmented.where("error is not null").select("tile_id", "error").distinct()


def report_failures(segmented: DataFrame) -> None:
    """A warning that names failed tiles; an error if no tile went well. segmented should be a written table."""
    failed = failed_tiles(segmented)
    some = failed.orderBy("tile_id").limit(5).collect()
    if some:
        if segmented.where("error is null").isEmpty():
            raise RuntimeError(f"segmentation failed on every tile, first on tile {some[0]['tile_id']}: {some[0]['error']}")
        warnings.warn(f"segmentation failed on {failed.count()} tiles: " + "; ".join(f"tile {x['tile_id']}: {x['error']}" for x in some), stacklevel=3)


def prepared(px: DataFrame, scale_bands: bool, smooth: int, smooth_edge: str = "null") -> DataFrame:
    """Missing values marked, smoothed, then scaled over the whole raster."""
    out = prepare.smooth_mean(px, smooth, smooth_edge) if smooth > 1 else px
    return prepare.zscore_bands(out) if scale_bands else out


def in_memory(px: DataFrame, nrow: int, ncol: int, fun: Segmenter, args: dict, scale_bands: bool = False, smooth: int = 0) -> DataFrame:
    """(r, c, segment_id) with the whole raster as one tile."""
    n = prepare.n_bands(px)
    return segment_tiles(prepared(px, scale_bands, smooth), nrow, ncol, fun, args, n=n, strict=True).select("r", "c", "segment_id")


def fh_segmenter(px: DataFrame, nrow: int, ncol: int, k: float = 1.0, min_size: int = 50, eight: bool = True, scale_bands: bool = True, smooth: int = 0) -> DataFrame:
    return in_memory(px, nrow, ncol, fh_segment, {"k": k, "min_size": min_size, "eight": eight}, scale_bands, smooth)


def hybrid_segmenter(px: DataFrame, nrow: int, ncol: int, scale_bands: bool = True, smooth: int = 3, **args) -> DataFrame:
    """Graph-based superpixels and mean-shift over them; args as in kernels.hybrid."""
    return in_memory(px, nrow, ncol, hybrid_segment, args, scale_bands, smooth)


def meanshift_segmenter(px: DataFrame, nrow: int, ncol: int, scale_bands: bool = True, smooth: int = 0, return_filtered: bool = False, **args) -> DataFrame:
    """args as in kernels.meanshift; return_filtered adds the filtered bands, 0 where a band is missing."""
    ready = prepared(px, scale_bands, smooth)
    out = segment_tiles(ready, nrow, ncol, meanshift_segment, args | {"return_filtered": return_filtered}, filtered=return_filtered, n=prepare.n_bands(px), strict=True)
    return out.select("r", "c", "segment_id", *["filtered"] * return_filtered)


def baatz_segmenter(px: DataFrame, nrow: int, ncol: int, smooth: int = 0, **args) -> DataFrame:
    return in_memory(px, nrow, ncol, baatz_segment, args, False, smooth)


def baatz_fast_segmenter(px: DataFrame, nrow: int, ncol: int, smooth: int = 0, **args) -> DataFrame:
    """A raster too large for a window is segmented in windows, with the same labels."""
    if nrow * ncol <= windows.MOST * windows.CELLS:
        return in_memory(px, nrow, ncol, baatz_fast_segment, args, False, smooth)
    n = prepare.n_bands(px)
    check_call(baatz_fast_segment, args, n)
    return windows.best_first(prepared(px, False, smooth), nrow, ncol, n, partial(baatz_fast_segment, **args))


def seeds_segmenter(px: DataFrame, nrow: int, ncol: int, smooth: int = 0, **args) -> DataFrame:
    return in_memory(px, nrow, ncol, seeds_segment, args, False, smooth)


def tile_engine(
    px: DataFrame, nrow: int, ncol: int, fun: Segmenter, args: dict | None = None, tile_size: int = 2048, buffer: int = 64, seam_thr: float = 0.8,
    scale_bands: bool = True, smooth: int = 0, seam_scope: str = "cross_tile", mosaic_rule: str = "inner", seam_space: str = "raw", stats_scope: str = "scene", eight: bool = True, tile_dir: str | None = None, cleanup_seg_tiles: bool = True,
) -> DataFrame:
    """(r, c, segment_id): tiles segmented in parallel, labels merged over seams where means are less than seam_thr apart, numbered 1..K.

    seam_scope: cross_tile merges labels that touch across tiles' borders; within_tile those that touch near them inside one
    tile. mosaic_rule: inner or last_wins. seam_space: means of the raw or the scaled bands. stats_scope: bands are scaled over
    the scene or tile by tile. Kernels run once, and hand the bands that seams are compared in through, so that pixels are
    shuffled once where nothing is smoothed; labels and image are written, and the labels' table is deleted unless tile_dir
    names a folder to keep it in and cleanup_seg_tiles is off. Failed tiles are named in a warning; if all fail, it raises.
    """
    for value, known in ((seam_scope, ("cross_tile", "within_tile")), (mosaic_rule, ("inner", "last_wins")), (seam_space, ("raw", "scaled")), (stats_scope, ("scene", "tile"))):
        if value not in known:
            raise ValueError(f"{value} is none of {known}")
    n = prepare.n_bands(px)
    args = dict(args or {})
    check_call(fun, args, n)
    smoothed = prepare.smooth_mean(px, smooth, n=n) if smooth > 1 else px
    carried = smooth <= 1 and seam_space == "raw"  # the bands that means are taken of come along
    smoothed = smoothed.withColumn("raw", F.col("bands")) if carried else smoothed
    ready = prepare.zscore_bands(smoothed, n) if scale_bands and stats_scope == "scene" else smoothed
    whole = seam_scope == "within_tile" or mosaic_rule == "last_wins"
    cut = segment_tiles(ready, nrow, ncol, fun, args, tile_size, buffer, scale_tiles=scale_bands and stats_scope == "tile", keep_buffer=whole, n=n)
    segmented = Written(cut, "tiles")
    report_failures(segmented.df)
    labelled = Written(tiles.make_global(segmented.df.drop("error")), "tiles-global", tile_dir)
    segmented.drop()
    tiled = labelled.df
    image = tiles.mosaic(tiled, mosaic_rule)
    if seam_scope == "cross_tile":
        pairs = tiles.cross_tile_pairs(image, nrow, ncol, tile_size, eight, buffer if mosaic_rule == "last_wins" else 0)
        seen = image if mosaic_rule == "last_wins" else tiled.where("inner")
    else:
        table = tiles.make_tiles(px.sparkSession, nrow, ncol, tile_size, buffer)
        pairs = tiles.seam_pairs(tiles.seam_mask(tiled, broadcast_if_small(table), buffer), eight)
        seen = tiled
    pairs = Written(pairs, "seam-pairs")
    ids = Written(image.where("segment_id is not null").select(F.col("segment_id").alias("old_id")).distinct(), "seam-ids")
    merged = ids.df.withColumn("new_id", F.col("old_id"))
    if not pairs.df.isEmpty():
        wanted = pairs.df.select(F.explode(F.array("a", "b")).alias("segment_id")).distinct()
        if "raw" in seen.columns:
            means = regions.means_of(seen.where("segment_id is not null").withColumn("bands", F.col("raw")), n, wanted)
        else:
            means = regions.segment_means((ready if seam_space == "scaled" else px).drop("raw"), seen.drop("raw"), n, wanted)
        found = labels.merge_by_adjacency(pairs.df, means, seam_thr)
        merged = ids.df.join(found, "old_id", "left").select("old_id", F.coalesce("new_id", "old_id").alias("new_id"))
    # merging and numbering as one lookup
    merged = Written(merged, "seam-merged")
    numbers = labels.ranked(merged.df.select("new_id").distinct(), "new_id").select("new_id", "rank")
    mapping = Written(merged.df.join(numbers, "new_id").select("old_id", F.col("rank").alias("new_id")), "seam-map")
    out = Written(labels.apply_merge_map(image, mapping.df), "segments")
    for t in (pairs, ids, merged, mapping):
        t.drop()
    if not tile_dir or cleanup_seg_tiles:
        labelled.drop()
    return out.df


def fh_segmenter_tile(px: DataFrame, nrow: int, ncol: int, tile_size: int = 2048, buffer: int = 64, seam_thr: float = 0.7, k: float = 1.0, min_size: int = 50, eight: bool = True, scale_bands: bool = True, smooth: int = 0, **options) -> DataFrame:
    return tile_engine(px, nrow, ncol, fh_segment, {"k": k, "min_size": min_size, "eight": eight}, tile_size, buffer, seam_thr, scale_bands, smooth, **options)


def hybrid_segmenter_tile(
    px: DataFrame, nrow: int, ncol: int, tile_size: int = 1536, buffer: int = 96, seam_thr: float = 0.8, scale_bands: bool = True, smooth: int = 3, seam_scope: str = "cross_tile", mosaic_rule: str = "inner",
    seam_space: str = "raw", stats_scope: str = "scene", ms_dim: int = 3, tile_dir: str | None = None, cleanup_seg_tiles: bool = True, **args,
) -> DataFrame:
    """args as in kernels.hybrid."""
    return tile_engine(px, nrow, ncol, hybrid_segment, {"ms_dim": ms_dim} | args, tile_size, buffer, seam_thr, scale_bands, smooth, seam_scope, mosaic_rule, seam_space, stats_scope, tile_dir=tile_dir, cleanup_seg_tiles=cleanup_seg_tiles)
