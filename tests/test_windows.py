"""Best-pair-first merging in windows beside one tile for the whole raster: the same labels."""

from math import fsum

import numpy as np
import pandas as pd
import pytest

from rasterloom.kernels.baatz import baatz_fast_segment
from rasterloom.operators import prepare, segment, windows


def image(kind, h, w, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.normal(0, 10, (2, h, w))
    if kind == "flat":  # ties everywhere
        return np.kron(rng.integers(0, 4, (1, -(-h // 6), -(-w // 7))), np.ones((2, 6, 7)))[:, :h, :w] * 30.0
    y, x = np.mgrid[:h, :w]
    return np.stack([40 * np.sin(y / 9) + 30 * np.cos(x / 13), y - x / 2.0]) + rng.normal(0, 2, (2, h, w))


def pixels(spark, x, keep=None):
    nb, h, w = x.shape
    r, c = np.divmod(np.arange(h * w), w)
    t = pd.DataFrame({"r": r, "c": c} | {f"b{i}": x[i].ravel() for i in range(nb)})
    return prepare.from_columns(spark.createDataFrame(t if keep is None else t[keep.ravel()]), [f"b{i}" for i in range(nb)])


def small_windows(monkeypatch, cells, halo, most=4):
    for name, value in (("CELLS", cells), ("HALO", halo), ("MOST", most)):
        monkeypatch.setattr(windows, name, value)


def labels_of(spark, x, keep=None, **args):
    h, w = x.shape[1:]
    t = segment.baatz_fast_segmenter(pixels(spark, x, keep), h, w, **args).toPandas()
    out = np.zeros((h, w), np.int64)
    out[t.r, t.c] = t.segment_id
    assert len(t) == (h * w if keep is None else keep.sum())
    return out


@pytest.mark.parametrize("kind, h, w, scale, cells, halo", [
    ("noise", 90, 41, 12, 400, 6), ("noise", 37, 80, 30, 300, 2), ("flat", 50, 45, 20, 256, 4), ("smooth", 200, 7, 40, 200, 0), ("flat", 30, 24, 1000, 100, 3),
])
def test_windows_are_the_whole(spark, monkeypatch, kind, h, w, scale, cells, halo):
    """Halos that are too small and segments larger than windows included; equal labels, not only the same partition."""
    small_windows(monkeypatch, cells, halo)
    x = image(kind, h, w)
    np.testing.assert_array_equal(labels_of(spark, x, scale_param=scale, color_weight=0.6), baatz_fast_segment(x, scale, 0.6))


def test_windows_with_missing_values_and_pixels(spark, monkeypatch):
    """Some windows have no pixel at all."""
    x = image("smooth", 70, 60)
    x[0, 3:9, 5:30] = np.nan
    keep = np.ones((70, 60), bool)
    keep[25:60, 10:55] = False
    whole = labels_of(spark, x, keep, scale_param=15)
    small_windows(monkeypatch, 200, 3)
    np.testing.assert_array_equal(labels_of(spark, x, keep, scale_param=15), whole)
    np.testing.assert_array_equal(whole, np.where(keep, baatz_fast_segment(np.where(keep, x, np.nan), 15), 0))


def test_no_task_holds_the_whole_raster(spark, monkeypatch):
    def bounded(block, **args):
        assert block[0].size <= windows.CELLS * windows.MOST
        return np.arange(1, block[0].size + 1).reshape(block.shape[1:])

    monkeypatch.setattr(segment, "baatz_fast_segment", bounded)
    px = spark.range(1500 * 100).selectExpr("cast(id div 100 as int) r", "cast(id % 100 as int) c", "array(cast(id as double)) bands")
    got = segment.baatz_fast_segmenter(px, 1500, 100)
    assert got.count() == 150_000 and got.where("segment_id <> r * 100 + c + 1").isEmpty()


def test_means_are_exact(spark):
    x = np.random.default_rng(0).normal(0, 1, 500) * 10.0 ** np.random.default_rng(1).integers(-12, 12, 500)
    values = [*x.tolist(), 1e200, -1e200, 5e-324, -0.0, None, float("nan")]
    px = spark.createDataFrame([([v, None],) for v in values], "bands array<double>")
    for n in (1, 7):
        assert windows.exact_means(px.repartition(n), 2, len(values)) == [fsum(v for v in values[:-2]) / (len(values) - 2), 0.0]
    assert windows.exact_means(px.limit(10), 1, 10) is None and windows.exact_means(px.limit(10), 1, 11) is not None


def test_flat_blocks_in_many_windows(spark, small, monkeypatch):
    """Equal factors everywhere, in the query whose right labels SQL builds; windows cut through the blocks."""
    import duckdb

    from rasterloom.plans.queries import ORACLE_SQL, QUERIES

    small_windows(monkeypatch, 64, 3)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{small}/events.parquet'")
    want = con.execute(ORACLE_SQL["baatz_fast_flat_blocks"]).df()
    largest = []
    monkeypatch.setattr(segment, "in_memory", lambda *a: largest.append(a))  # one task for all is not used
    got = QUERIES["baatz_fast_flat_blocks"](spark, small).toPandas()
    assert not largest and len(got) == len(want) > 0
    assert sorted(zip(got.r, got.c, got.segment_id)) == sorted(zip(want.r, want.c, want.segment_id))
