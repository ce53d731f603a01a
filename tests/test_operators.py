import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.kernels.graph import fh_segment
from rasterloom.kernels.meanshift import meanshift_filter
from rasterloom.operators import adjacency, components, labels, prepare, regions, segment, tiles
from rasterloom.operators.components import connected_components


def pixels(spark, x):
    nb, h, w = x.shape
    r, c = np.divmod(np.arange(h * w), w)
    return prepare.from_columns(spark.createDataFrame(pd.DataFrame({"r": r, "c": c} | {f"b{i}": x[i].ravel() for i in range(nb)})), [f"b{i}" for i in range(nb)])


def grid(df, h, w, column="segment_id"):
    t = df.toPandas()
    out = np.zeros((h, w), np.int64)
    out[t.r, t.c] = t[column].fillna(0)
    return out


def blocks(h=40, w=28, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    base = np.kron(rng.permutation(np.arange(-(-h // 10) * -(-w // 7))).reshape(1, -(-h // 10), -(-w // 7)), np.ones((1, 10, 7)))[:, :h, :w] * 10
    return np.concatenate([base, base % 50]) + rng.normal(0, noise, (2, h, w))


@pytest.mark.parametrize("last", [0, 100, 10_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST", last)  # 0: contraction alone
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (6000, 6001), (6001, 6000), (None, 3), (7, None)]
    edges += [(int(a) + 10_000, int(b) + 10_000) for a, b in rng.integers(0, 400, (250, 2))]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert dict(zip(got.node, got.component)) == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_example(spark):
    means = spark.createDataFrame([(1, [0.10, 0.20]), (2, [0.11, 0.19]), (3, [0.12, 0.18]), (10, [0.80, 0.75]), (11, [0.81, 0.74])], "segment_id long, mean array<double>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a long, b long")
    got = {r["old_id"]: r["new_id"] for r in labels.merge_by_adjacency(pairs, means, 0.05).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert {r["new_id"] for r in labels.merge_by_adjacency(pairs, means, 0.01).collect()} == {1, 2, 3, 10, 11}
    missing = means.where("segment_id <> 2").unionByName(spark.createDataFrame([(2, [None, 0.1])], "segment_id long, mean array<double>"))
    assert labels.merge_by_adjacency(pairs, missing, 0.05).where("old_id <> new_id").count() == 1
    assert labels.merge_by_adjacency(pairs.limit(0), means, 0.05).count() == 0


@pytest.mark.parametrize("edge", ["null", "shrink"])
def test_smoothing(spark, edge):
    x = blocks(12, 9)
    x[0, 4, 4] = np.nan
    got = prepare.to_columns(prepare.smooth_mean(pixels(spark, x), 3, edge), 2).toPandas().set_index(["r", "c"])
    for (r, c), row in got.iterrows():
        for k in range(2):
            window = x[k, max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            whole = window.size == 9 and not np.isnan(window).any()
            if np.isnan(x[k, r, c]) or (edge == "null" and not whole):
                assert np.isnan(row.iloc[k])
            else:
                assert np.isclose(row.iloc[k], np.nanmean(window))
    with pytest.raises(ValueError):
        prepare.smooth_mean(pixels(spark, x), 4)


def test_infinite_and_missing_values(spark):
    x = np.array([[[1.0, np.inf, 3.0, np.nan]], [[1.0, 2.0, -np.inf, 4.0]]])
    px = pixels(spark, x)
    assert prepare.na_count(px).first()["n_na"] == 3
    z = prepare.to_columns(prepare.zscore_bands(px), 2).toPandas()
    assert z.b1.notna().tolist() == [True, False, True, False]
    flat = prepare.to_columns(prepare.zscore_bands(pixels(spark, np.ones((1, 2, 2)))), 1).toPandas()
    assert (flat.b1 == 0).all()


def test_missing_rows_are_invalid_neighbours(spark):
    x = blocks(6, 5)
    px = pixels(spark, x).where("not (r = 2 and c = 2)")
    got = {(r["a"], r["b"]) for r in adjacency.adjacency_edges(px, 5, True).collect()}
    assert not any(12 in e for e in got)
    expected = set()
    for r in range(6):
        for c in range(5):
            for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
                y, z = r + dr, c + dc
                if 0 <= y < 6 and 0 <= z < 5 and (r, c) != (2, 2) and (y, z) != (2, 2):
                    expected.add((r * 5 + c, y * 5 + z))
    assert got == expected


def test_relabelling(spark):
    seg = spark.createDataFrame([(0, 0, 70), (0, 1, None), (0, 2, 5), (1, 0, 5), (1, 1, 9_000_000_000), (1, 2, 0)], "r int, c int, segment_id long")
    assert grid(labels.relabel_global(seg), 2, 3).tolist() == [[3, 0, 2], [2, 4, 1]]
    assert grid(labels.relabel_first_seen(seg, 3), 2, 3).tolist() == [[1, 0, 2], [2, 3, 4]]
    mapping = spark.createDataFrame([(70, 5), (5, 1)], "old_id long, new_id long")
    assert grid(labels.apply_merge_map(seg, mapping), 2, 3).tolist() == [[5, 0, 1], [1, 9_000_000_000, 0]]
    assert labels.relabel_global(seg.limit(0)).count() == 0


def test_connectivity(spark):
    seg = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 1, 2), (1, 2, 1)], "r int, c int, segment_id long")
    assert [tuple(r) for r in regions.disconnected_segments(seg, False).collect()] == [(1, 2)]
    assert grid(labels.enforce_connectivity(seg, 3, False), 2, 3).tolist() == [[1, 2, 3], [2, 2, 3]]


@pytest.mark.parametrize("h, w, size, buffer", [(10, 7, 4, 1), (8, 8, 8, 3), (9, 5, 2, 3), (1, 6, 4, 2)])
def test_tiles_cover_their_windows(spark, h, w, size, buffer):
    px = pixels(spark, np.zeros((1, h, w))).select("r", "c")
    got = tiles.assign_pixels(px, h, w, size, buffer).toPandas()
    for t in tiles.make_tiles(spark, h, w, size, buffer).collect():
        mine = got[got.tile_id == t["tile_id"]]
        window = {(r, c) for r in range(t["r0_buf"], t["r1_buf"]) for c in range(t["c0_buf"], t["c1_buf"])}
        assert set(zip(mine.r, mine.c)) == window and len(mine) == len(window)
        own = mine[mine.inner]
        assert set(zip(own.r, own.c)) == {(r, c) for r in range(t["r0_in"], t["r1_in"]) for c in range(t["c0_in"], t["c1_in"])}
    assert got.inner.sum() == h * w


def test_whole_raster_segmenters_are_the_kernels(spark):
    x = blocks()
    h, w = x.shape[1:]
    got = grid(segment.fh_segmenter(pixels(spark, x), h, w, k=2.0, min_size=5, scale_bands=False), h, w)
    assert np.array_equal(got, fh_segment(x, 2.0, 5))
    scaled = grid(segment.fh_segmenter(pixels(spark, x), h, w, k=1.0, min_size=5), h, w)
    assert np.array_equal(scaled, fh_segment(segment.scaled_block(x), 1.0, 5))


@pytest.mark.parametrize("options", [{}, {"mosaic_rule": "last_wins"}, {"stats_scope": "tile"}, {"seam_space": "scaled", "seam_thr": 0.1}])
def test_tiles_join_over_seams(spark, options):
    """Separate blocks that tiles cut come out whole."""
    x = blocks(noise=0.05)
    h, w = x.shape[1:]
    args = {"tile_size": 15, "buffer": 3, "seam_thr": 5.0, "min_size": 8 if "seam_space" in options or "stats_scope" in options else 1, "k": 0.15 if "seam_space" in options or "stats_scope" in options else 15.0, "scale_bands": "seam_space" in options or "stats_scope" in options} | options
    got = grid(segment.fh_segmenter_tile(pixels(spark, x), h, w, **args), h, w)
    truth = np.kron(np.arange(16).reshape(4, 4), np.ones((10, 7), int))
    pairs = set(zip(got.ravel(), truth.ravel()))
    assert sorted(set(got.ravel())) == list(range(1, got.max() + 1))
    if "stats_scope" not in options:
        assert len(pairs) == 16 == got.max()
    else:
        assert len(pairs) == got.max()


def test_within_tile_scope_never_joins_tiles(spark):
    x = np.zeros((1, 20, 20)) + np.arange(20) * 1e-6
    got = grid(segment.fh_segmenter_tile(pixels(spark, x), 20, 20, tile_size=10, buffer=2, seam_thr=1.0, min_size=1, scale_bands=False, seam_scope="within_tile"), 20, 20)
    assert got.max() == 4
    joined = grid(segment.fh_segmenter_tile(pixels(spark, x), 20, 20, tile_size=10, buffer=2, seam_thr=1.0, min_size=1, scale_bands=False), 20, 20)
    assert joined.max() == 1
    with pytest.raises(ValueError):
        segment.fh_segmenter_tile(pixels(spark, x), 20, 20, seam_scope="else")


def test_meanshift_filter_is_exact_under_tiling(spark):
    x = blocks(20, 16)

    def meanshift(block, radius):
        return np.ones(block.shape[1:], int), meanshift_filter(block, radius, 1.0, 5, 1e-3)

    one = segment.segment_tiles(pixels(spark, x), 20, 16, meanshift, {"radius": 2}, tile_size=7, buffer=10, filtered=True, keep_buffer=False)
    t = one.toPandas()
    whole = meanshift_filter(x, 2, 1.0, 5, 1e-3)
    assert np.allclose(np.stack(t.filtered), whole[:, t.r, t.c].T, atol=1e-4)


def test_a_failing_tile_leaves_the_others(spark):
    def picky(block, bad):
        if block.shape[1] < bad:
            raise RuntimeError("too few rows")
        return np.stack([np.ones(block.shape[1:]), np.zeros(block.shape[1:])])

    got = segment.segment_tiles(pixels(spark, blocks(25, 10)), 25, 10, picky, {"bad": 10}, tile_size=10).toPandas()
    assert got[got.r < 20].segment_id.eq(1).all() and got[got.r >= 20].segment_id.isna().all()
    assert got[got.r >= 20].error.eq("RuntimeError: too few rows").all() and got[got.r < 20].error.isna().all()


def test_missing_pixels_stay_unlabelled(spark):
    x = blocks()
    x[0, 5:12, 3:9] = np.nan
    for f in (segment.fh_segmenter, segment.hybrid_segmenter, segment.meanshift_segmenter):
        got = grid(f(pixels(spark, x), 40, 28, **({"smooth": 0} if f is not segment.fh_segmenter else {})), 40, 28)
        assert np.array_equal(got > 0, ~np.isnan(x[0]))


def test_rows_of_a_raster_with_one_line(spark):
    seg = spark.createDataFrame([(0, c, 1 + c // 3) for c in range(9)], "r int, c int, segment_id long")
    assert adjacency.region_adjacency(seg).count() == 2
    assert {r["perimeter"] for r in regions.region_perimeter(seg).collect()} == {8}


def test_plans(spark, small):
    """Scaling needs no join and no shuffle of pixels; only the needed columns reach the scan."""
    from rasterloom.plans import fixtures as fx

    p = prepare.zscore_bands(fx.raster(spark, small, "px_events"), 3)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "Join" not in plan and "Cartesian" not in plan, plan
    scan = fx.raster(spark, small, "px_orders").select("r")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in scan.split("ReadSchema")[1]


@pytest.mark.parametrize("nrow, ncol, row_scale, col_scale", [(6, 4, 2.0, 2.0), (5, 7, 2.7, 1.3), (30, 17, 0.45, 0.5), (3, 2, 1.0, 5.5), (13, 9, 1.0, 1.0), (20, 20, 2.0, 2.0), (0, 4, 2.0, 2.0)])
def test_resampled_grids(spark, nrow, ncol, row_scale, col_scale):
    x = np.random.default_rng(3).normal(0, 1, (2, 13, 9))
    x[0, 2:7, 3:6], x[1, 12, 8] = np.nan, np.nan
    there = np.ones((13, 9), bool)
    there[8:11, 4] = there[0, 0] = False
    px = pixels(spark, x).where("not (r between 8 and 10 and c = 4) and not (r = 0 and c = 0)")
    want = {}
    for r in range(nrow):
        for c in range(ncol):
            y, z = (r + 0.5) * row_scale - 0.5, (c + 0.5) * col_scale - 0.5
            near = [(sr, sc, (1 - abs(y - sr)) * (1 - abs(z - sc))) for sr in range(13) for sc in range(9) if abs(y - sr) < 1 and abs(z - sc) < 1 and there[sr, sc]]
            if near:
                known = [[(w, x[k, a, b]) for a, b, w in near if not np.isnan(x[k, a, b])] for k in range(2)]
                want[r, c] = [sum(w * v for w, v in k) / sum(w for w, _ in k) if k else None for k in known]
    got = {(t["r"], t["c"]): t["bands"] for t in prepare.align_resample(px, nrow, ncol, row_scale, col_scale).collect()}
    assert got.keys() == want.keys()
    for k, bands in want.items():
        assert [b is None for b in got[k]] == [b is None for b in bands]
        assert [b for b in got[k] if b is not None] == pytest.approx([b for b in bands if b is not None])


def test_resampling_broadcasts_no_grid(spark):
    """Targets made by explode look small to the optimizer (9 million rows for 45,000 x 50 cells); the driver held them all."""
    px = spark.range(100).selectExpr("cast(id as int) r", "0 c", "array(cast(id as double)) bands")
    plan = prepare.align_resample(px, 45_000, 50, 2.0, 2.0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
