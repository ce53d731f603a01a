import numpy as np
import pandas as pd
import pytest

from rasterloom.kernels.graph import fh_segment
from rasterloom.sources import geotiff, tables
from rasterloom.streaming.tiles import segment_stream


@pytest.mark.parametrize("dtype, compress, nodata", [("float64", True, None), ("float32", False, -9999.0), ("int32", True, -(2**31)), ("uint8", True, 0), ("int16", False, None)])
def test_file_round_trip(dtype, compress, nodata):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 200, (3, 37, 23)).astype(dtype)
    if nodata is not None:
        x[:, 3, 4] = nodata
    data = geotiff.encode(x, (500.0, 900.0), (10.0, 20.0), nodata, "UTM 35N", compress, rows_per_strip=8)
    t = geotiff.parse(data)
    assert t.shape == x.shape and t.one(geotiff.GEO_ASCII) == "UTM 35N" and t.nodata == nodata
    back = np.full(x.shape, -1.0)
    for r, c, v in geotiff.blocks(t, data):
        back[:, r : r + v.shape[1], c : c + v.shape[2]] = v
    expected = x.astype(float)
    if nodata is not None:
        expected[expected == nodata] = np.nan
    assert np.array_equal(back, expected, equal_nan=True)


def lzw(data):
    """An encoder written for this test."""
    table = {bytes([i]): i for i in range(256)}
    out, width, bits = [], 9, []
    emit = lambda code: bits.extend((code >> (width - 1 - k)) & 1 for k in range(width))
    emit(256)
    size, word = 258, b""
    for b in data:
        nxt = word + bytes([b])
        if nxt in table:
            word = nxt
            continue
        emit(table[word])
        table[nxt] = size
        size += 1
        if size == 512 or size == 1024 or size == 2048:
            width += 1
        if size == 4094:
            emit(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        emit(table[word])
        size += 1
        if size in (512, 1024, 2048):
            width += 1
    emit(257)
    bits.extend([0] * (-len(bits) % 8))
    out = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    return out


def test_lzw():
    rng = np.random.default_rng(0)
    for data in (b"", b"a" * 1000, bytes(rng.integers(0, 4, 5000, dtype=np.uint8)), bytes(rng.integers(0, 256, 9000, dtype=np.uint8))):
        assert geotiff.unpack_lzw(lzw(data)) == data


def test_tiled_planar_big_endian_with_predictor():
    """A file laid out by hand: two 16 x 16 tiles, two planes, differences along rows."""
    import struct
    import zlib

    x = np.arange(2 * 16 * 30, dtype=np.int16).reshape(2, 16, 30)
    wide = np.zeros((2, 16, 32), ">i2")
    wide[:, :, :30] = x
    parts = []
    for b in range(2):
        for j in range(2):
            tile = wide[b, :, j * 16 : j * 16 + 16].copy()
            tile[:, 1:] -= tile[:, :-1].copy()
            parts.append(zlib.compress(tile.tobytes()))
    starts = np.cumsum([8] + [len(p) for p in parts])
    directory = int(starts[-1])
    fields = [(256, 3, [30]), (257, 3, [16]), (258, 3, [16, 16]), (259, 3, [8]), (277, 3, [2]), (284, 3, [2]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, starts[:-1].tolist()), (325, 4, [len(p) for p in parts]), (339, 3, [2, 2])]
    tail, table = b"", b""
    extra = directory + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = struct.pack(f">{len(v)}{'H' if kind == 3 else 'I'}", *v)
        place = raw.ljust(4, b"\x00") if len(raw) <= 4 else struct.pack(">I", extra + len(tail))
        tail += raw if len(raw) > 4 else b""
        table += struct.pack(">HHI", tag, kind, len(v)) + place
    data = struct.pack(">2sHI", b"MM", 42, directory) + b"".join(parts) + struct.pack(">H", len(fields)) + table + struct.pack(">I", 0) + tail
    back = np.zeros(x.shape)
    for r, c, v in geotiff.blocks(geotiff.parse(data), data):
        back[:, r : r + v.shape[1], c : c + v.shape[2]] = v
    assert np.array_equal(back, x)


def test_spark_reads_and_writes_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    h, w = 50, 20
    seg = pd.DataFrame({"r": np.repeat(np.arange(h), w).astype("int32"), "c": np.tile(np.arange(w), h).astype("int32"), "segment_id": rng.integers(1, 100, h * w)})
    seg.loc[5, "segment_id"] = -1
    df = spark.createDataFrame(seg).selectExpr("r", "c", "nullif(segment_id, -1) as segment_id")
    geotiff.write_geotiff(geotiff.encode_labels(df, h, w, block_rows=16, origin=(100.0, 1000.0), resolution=(2.0, 2.0), crs="local"), f"file://{tmp_path}/out", "seg")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.tif")) == [f"seg_{i:05d}.tif" for i in range(4)]
    meta = geotiff.read_metadata(spark, f"file://{tmp_path}/out/*.tif").orderBy("raster_id").toPandas()
    assert meta.nrow.tolist() == [16, 16, 16, 2] and meta.ymax.tolist() == [1000.0, 968.0, 936.0, 904.0] and set(meta.crs) == {"local"}
    back = geotiff.read_geotiff(spark, f"file://{tmp_path}/out/*.tif").toPandas()
    back["r"] += back.path.str.extract(r"_(\d{5})")[0].astype(int) * 16
    got = back.sort_values(["r", "c"]).bands.map(lambda b: -1 if b[0] is None or np.isnan(b[0]) else int(b[0]))
    assert got.tolist() == seg.sort_values(["r", "c"]).segment_id.tolist()
    with pytest.raises(OverflowError):
        geotiff.encode_labels(df.selectExpr("r", "c", "segment_id + 3000000000 as segment_id"), h, w)


def test_parquet_window_reads(spark, tmp_path):
    px = spark.range(10_000).selectExpr("cast(id div 100 as int) as r", "cast(id % 100 as int) as c", "array(cast(id as double)) as bands")
    tables.write_raster(px, f"{tmp_path}/px", block=32)
    from rasterloom.operators.prepare import scan_window

    got = scan_window(tables.open_raster(spark, f"{tmp_path}/px"), 10, 20, 30, 40)
    assert got.count() == 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r,10)" in plan and "LessThan(r,20)" in plan


def test_stream_of_tiles(spark, tmp_path):
    x = np.kron(np.arange(6.0).reshape(1, 2, 3) * 30, np.ones((1, 10, 10)))
    r, c = np.divmod(np.arange(20 * 30), 30)
    table = pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32"), "bands": [[v] for v in x.ravel()]})
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame(table[table.c // 10 == k], "r int, c int, bands array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = segment_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 20, 30, fh_segment, {"k": 1.0, "min_size": 1}, tile_size=10)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert len(got) == 600 and got.tile_id.nunique() == 6 and got.groupby("tile_id").segment_id.nunique().eq(1).all()
