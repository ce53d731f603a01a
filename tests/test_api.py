import numpy as np
import pytest

from rasterloom import api
from rasterloom.kernels.graph import fh_segment
from rasterloom.sources import geotiff


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    return api.sample_raster_path(f"file://{tmp_path_factory.mktemp('sample')}", 60)


def test_sample_reads_as_a_raster(sample):
    x = api.rast(sample)
    assert (x.nrow, x.ncol, x.crs, x.resolution) == (60, 60, "UTM 35N", (10.0, 10.0)) and x.px.count() == 3600
    with pytest.raises(TypeError):
        api.rast(5)


@pytest.mark.parametrize("name", ["fh_segmenter", "fh_meanshift_segmenter", "meanshift_segmenter", "baatz_segmenter", "baatz_fast_segmenter", "seeds_segmenter"])
def test_segmenters_by_path(spark, sample, tmp_path, name, capsys):
    out = getattr(api, name)(sample, output_file=f"file://{tmp_path}/{name}.tif", verbose=True)
    t = out.toPandas()
    assert len(t) == 3600 and 1 < t.segment_id.nunique() < 3600
    assert "segments" in capsys.readouterr().out
    back = geotiff.read_geotiff(spark, f"file://{tmp_path}/{name}.tif").toPandas().sort_values(["r", "c"])
    assert [b[0] for b in back.bands if b[0] is not None and not np.isnan(b[0])] == t.sort_values(["r", "c"]).segment_id.dropna().tolist()


def test_filtered_bands(sample):
    seg, filtered = api.meanshift_segmenter(sample, return_filtered=True, verbose=False, spatialr=2)
    assert filtered.count() == 3600 and filtered.columns == ["r", "c", "bands"] and seg.columns == ["r", "c", "segment_id"]


def test_tiling_by_hand(spark, sample, tmp_path):
    meta = api.make_tiles_disk(sample, tile_size=32, buffer=4, dir=f"file://{tmp_path}")
    assert meta.count() == 4
    seg = api.segment_tiles(meta, fh_segment, {"k": 60.0, "min_size": 10}, out_dir=f"file://{tmp_path}")
    t = seg.toPandas()
    assert t.groupby("segment_id").tile_id.nunique().max() == 1 and t[t.inner].shape[0] == 3600
    means = api.segment_means_from_tiles(sample, seg, [1, 2, 10**6]).toPandas().set_index("segment_id")
    assert len(means) == 3 and means.loc[10**6, "mean"] is None and len(means.loc[1, "mean"]) == 3
    image = seg.where("inner").select("r", "c", "segment_id")
    new = api.relabel_segments_global(image, out_file=f"file://{tmp_path}/labels")
    assert sorted({r["segment_id"] for r in spark.read.parquet(f"file://{tmp_path}/labels").collect()}) == list(range(1, new.agg({"segment_id": "max"}).first()[0] + 1))
    with pytest.raises(ValueError):
        api.relabel_segments_global(image.limit(0))


def test_tile_wrappers(sample):
    a = api.fh_segmenter_tile(sample, tile_size=32, buffer=4, seam_thr=20.0, min_size=10, verbose=False)
    b = api.fh_meanshift_segmenter_tile(sample, tile_size=32, buffer=4, seam_thr=20.0, smooth=0, final_min_size=20, verbose=False)
    c = api.segmenter_tile_engine(sample, fh_segment, {"k": 60.0}, tile_size=32, buffer=4, seam_thr=20.0, verbose=False)
    for t in (a, b, c):
        top = t.agg({"segment_id": "max"}).first()[0]
        assert t.select("segment_id").distinct().count() == top > 1


def test_a_large_raster_is_a_folder_of_blocks(spark, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "SINGLE_FILE", 100)
    api.fh_segmenter(sample, output_file=f"file://{tmp_path}/big.tif", verbose=False)
    assert (tmp_path / "big" / "block_00000.tif").exists() and not (tmp_path / "big.tif").exists()


BAD = [
    ("fh_segmenter", {"k": 0.0}), ("fh_segmenter", {"k": -1}), ("fh_meanshift_segmenter", {"fh_k": 0.0}), ("fh_meanshift_segmenter", {"ms_ranger": 0.0}), ("meanshift_segmenter", {"ranger": 0.0}),
    ("baatz_segmenter", {"scale_param": 0}), ("baatz_segmenter", {"color_weight": 2}), ("baatz_fast_segmenter", {"compactness": -1}), ("baatz_fast_segmenter", {"band_weights": [1.0]}),
    ("seeds_segmenter", {"step": 0}), ("seeds_segmenter", {"nbins": 1}), ("fh_segmenter_tile", {"k": 0.0}), ("fh_meanshift_segmenter_tile", {"fh_k": 0.0}), ("fh_segmenter", {"smooth": 4}),
]


@pytest.mark.parametrize("name, options", BAD)
def test_bad_arguments_raise(sample, name, options):
    with pytest.raises(ValueError):
        getattr(api, name)(sample, verbose=False, **options)


@pytest.mark.parametrize("name", ["fh_segmenter", "fh_meanshift_segmenter", "meanshift_segmenter", "baatz_segmenter", "baatz_fast_segmenter", "seeds_segmenter", "fh_segmenter_tile", "fh_meanshift_segmenter_tile"])
def test_misspelt_options_raise(sample, name):
    with pytest.raises(TypeError):
        getattr(api, name)(sample, verbose=False, fh_kk=1.0)


def test_misspelt_segmenter_arguments_raise(sample, tmp_path):
    with pytest.raises(TypeError):
        api.segmenter_tile_engine(sample, fh_segment, {"kk": 1.0}, tile_size=32, buffer=4, verbose=False)
    meta = api.make_tiles_disk(sample, tile_size=32, buffer=4, dir=f"file://{tmp_path}", verbose=False)
    with pytest.raises(TypeError):
        api.segment_tiles(meta, fh_segment, {"kk": 1.0}, verbose=False)


def test_failed_tiles_are_named(sample):
    def picky(block, least):
        if block.shape[1] < least:
            raise RuntimeError("too few rows")
        return np.ones(block.shape[1:], int)

    with pytest.warns(UserWarning, match="failed on 2 tiles.*tile 2: RuntimeError: too few rows"):
        seg = api.segmenter_tile_engine(sample, picky, {"least": 35}, tile_size=32, buffer=4, verbose=False)
    assert seg.where("segment_id is null").count() == 28 * 60
    with pytest.raises(RuntimeError, match="every tile"):
        api.segmenter_tile_engine(sample, picky, {"least": 100}, tile_size=32, buffer=4, verbose=False)


def test_tile_folders(sample, tmp_path):
    """Tiles aren't overwritten unless asked for; the engine's tiles are kept or deleted."""
    folder = f"file://{tmp_path}"
    meta = api.make_tiles_disk(sample, tile_size=32, buffer=4, dir=folder, verbose=False)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        api.make_tiles_disk(sample, tile_size=32, buffer=4, dir=folder, overwrite=False, verbose=False)
    meta = meta.sparkSession.createDataFrame(meta.collect(), meta.schema)
    api.segment_tiles(meta, fh_segment, out_dir=folder, cleanup_tiles=True, verbose=False)
    assert not (tmp_path / "tile").exists() and (tmp_path / "seg").exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        api.segment_tiles(meta, fh_segment, out_dir=folder, verbose=False)
    for name, options in (("fh_segmenter_tile", {}), ("fh_meanshift_segmenter_tile", {"smooth": 0})):
        kept, gone = tmp_path / f"{name}-kept", tmp_path / f"{name}-gone"
        a = getattr(api, name)(sample, tile_size=32, buffer=4, tile_dir=f"file://{kept}", verbose=False, **options)
        b = getattr(api, name)(sample, tile_size=32, buffer=4, tile_dir=f"file://{gone}", cleanup_tiles=True, cleanup_seg_tiles=True, verbose=False, **options)
        assert any(kept.iterdir()) and not any(gone.iterdir()) and a.where("segment_id is not null").count() == b.where("segment_id is not null").count() == 3600
