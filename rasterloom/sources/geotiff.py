"""GeoTIFF files as a Spark data source, with numpy and the standard library alone.

Reads baseline TIFF and BigTIFF of either byte order: strips or tiles, contiguous or planar bands, integers and floats of 8 to
64 bits, without compression, with deflate or LZW, horizontal predictor, and a nodata value. Each strip or row of tiles is a
partition of its own. Files are read with Spark's binaryFile reader, so any store that Spark reads will do.

    read_geotiff(spark, path)               -> (path, r, c, bands)
    read_metadata(spark, path)              -> one row per file: size, bands, origin, resolution, names of the coordinate system
    write_geotiff(seg, path, nrow, ncol)    -> one file per block of rows and one index file of metadata, or a single file
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the TIFF 6.0, BigTIFF, GeoTIFF and nodata conventions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_ASCII, NODATA = 33550, 33922, 34737, 42113
#: Bytes and struct codes of the field types.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}


@dataclass
class Tiff:
    """What a file's first directory says."""

    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(SAMPLES, 1), self.one(LENGTH), self.one(WIDTH)

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(BITS, 1), {1: "u", 2: "i", 3: "f"}[self.one(SAMPLE_FORMAT, 1)]
        if bits % 8:
            raise ValueError(f"{bits} bits a sample aren't read")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def nodata(self) -> float | None:
        text = self.one(NODATA)
        return float(text.strip("\x00 ")) if text and text.strip("\x00 ") else None

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a strip or tile."""
        if TILE_WIDTH in self.tags:
            return self.one(TILE_LENGTH), self.one(TILE_WIDTH)
        return min(self.one(ROWS_PER_STRIP, self.one(LENGTH)), self.one(LENGTH)), self.one(WIDTH)


def parse(data: bytes) -> Tiff:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(f"{order}H", data, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}Q" if big else f"{order}I", data, 8 if big else 4)[0]
    n = struct.unpack_from(f"{order}Q" if big else f"{order}H", data, at)[0]
    at += 8 if big else 2
    entry, inline = (20, 8) if big else (12, 4)
    out = Tiff(order)
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", data, at + k * entry)
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        value = at + k * entry + (12 if big else 8)
        if size * count > inline:
            value = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, value)[0]
        if kind == 2:
            out.tags[tag] = (data[value : value + count].split(b"\x00")[0].decode("latin-1"),)
        else:
            out.tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, value)
    return out


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, one bit wider a code early."""
    clear, end = 256, 257
    table: list[bytes] = []
    out: list[bytes] = []
    width, previous, held, bits = 9, b"", 0, 0
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == end:
            break
        if code == clear or not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            width, previous = 9, b""
            if code == clear:
                continue
        if code < len(table):
            entry = table[code]
        elif previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def unpacked(tiff: Tiff, raw: bytes) -> bytes:
    compression = tiff.one(COMPRESSION, 1)
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 5:
        return unpack_lzw(raw)
    raise ValueError(f"compression {compression} isn't read")


def blocks(tiff: Tiff, data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values (band, row, column)) of each strip or tile, nodata as NaN."""
    nb, h, w = tiff.shape
    bh, bw = tiff.block
    tiled = TILE_WIDTH in tiff.tags
    offsets, counts = tiff.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tiff.tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    across, down = -(-w // bw), -(-h // bh)
    planar = tiff.one(PLANAR, 1) == 2
    per = 1 if planar else nb

    def values(k: int, rows: int) -> np.ndarray:
        got = np.frombuffer(unpacked(tiff, data[offsets[k] : offsets[k] + counts[k]]), tiff.dtype)
        got = got[: rows * bw * per].reshape(rows, bw, per)
        if tiff.one(PREDICTOR, 1) == 2:
            got = np.cumsum(got, axis=1, dtype=tiff.dtype)
        elif tiff.one(PREDICTOR, 1) != 1:
            raise ValueError("this predictor isn't read")
        return np.moveaxis(got, -1, 0)

    for i in range(down):
        rows = bh if tiled else min(bh, h - i * bh)
        for j in range(across):
            k = i * across + j
            got = np.concatenate([values(k + b * across * down, rows) for b in range(nb)]) if planar else values(k, rows)
            out = got[:, : min(rows, h - i * bh), : min(bw, w - j * bw)].astype(float)
            if tiff.nodata is not None:
                out[out == tiff.nodata] = np.nan
            yield i * bh, j * bw, out


def encode(image: np.ndarray, origin: tuple[float, float] = (0.0, 0.0), resolution: tuple[float, float] = (1.0, 1.0), nodata: float | None = None, crs: str = "", compress: bool = True, rows_per_strip: int = 256) -> bytes:
    """A TIFF of (band, row, column), in strips of interleaved bands, deflated if compress; BigTIFF where 32 bits don't reach."""
    nb, h, w = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    strips = [np.ascontiguousarray(np.moveaxis(image[:, r : r + rows_per_strip], 0, -1)).astype(image.dtype.newbyteorder("<")).tobytes() for r in range(0, h, rows_per_strip)]
    strips = [zlib.compress(s) if compress else s for s in strips]
    big = sum(map(len, strips)) > 4_000_000_000
    head, inline = (16, 8) if big else (8, 4)
    word, long_kind = ("Q", 16) if big else ("I", 4)
    starts = np.cumsum([head] + [len(s) for s in strips])
    fields = [
        (WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [image.dtype.itemsize * 8] * nb), (COMPRESSION, 3, [8 if compress else 1]), (PHOTOMETRIC, 3, [1]),
        (STRIP_OFFSETS, long_kind, starts[:-1].tolist()), (SAMPLES, 3, [nb]), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, long_kind, [len(s) for s in strips]),
        (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [kind] * nb), (PIXEL_SCALE, 12, [resolution[0], resolution[1], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]),
    ]
    texts = [(GEO_ASCII, crs)] * bool(crs) + [(NODATA, repr(nodata))] * (nodata is not None)
    encoded = [(t, k, len(v), struct.pack(f"<{len(v)}{TYPES[k][1]}", *v)) for t, k, v in fields] + [(t, 2, len(v) + 1, v.encode("latin-1") + b"\x00") for t, v in texts]
    directory = int(starts[-1]) + int(starts[-1]) % 2
    entry = 20 if big else 12
    extra = directory + (8 if big else 2) + entry * len(encoded) + (8 if big else 4)
    table, tail = b"", b""
    for tag, k, n, value in encoded:
        if len(value) <= inline:
            place = value.ljust(inline, b"\x00")
        else:
            place = struct.pack(f"<{word}", extra + len(tail))
            tail += value + b"\x00" * (len(value) % 2)
        table += struct.pack(f"<HH{word}", tag, k, n) + place
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, directory) if big else struct.pack("<2sHI", b"II", 42, directory)
    body = b"".join(strips)
    gap = b"\x00" * (directory - head - len(body))
    return start + body + gap + struct.pack("<Q" if big else "<H", len(encoded)) + table + struct.pack(f"<{word}", 0) + tail


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, bands) of every pixel of the files; nodata and values that aren't finite are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                content = bytes(content)
                for r0, c0, values in blocks(parse(content), content):
                    nb, h, w = values.shape
                    r, c = np.divmod(np.arange(h * w), w)
                    bands = values.reshape(nb, -1).T
                    rows = [[x if np.isfinite(x) else None for x in px] for px in bands.tolist()] if not np.isfinite(bands).all() else bands.tolist()
                    yield pd.DataFrame({"path": name, "r": (r + r0).astype(np.int32), "c": (c + c0).astype(np.int32), "bands": rows})

    return files(spark, path).mapInPandas(run, "path string, r int, c int, bands array<double>")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, nrow, ncol, nb, xmin, ymax, xres, yres, crs) by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                t = parse(bytes(content))
                nb, h, w = t.shape
                scale, tie = t.tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.tags.get(TIEPOINT, (0.0,) * 6)
                rows.append((name, h, w, nb, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], t.one(GEO_ASCII, "")))
            yield pd.DataFrame(rows, columns=["raster_id", "nrow", "ncol", "nb", "xmin", "ymax", "xres", "yres", "crs"])

    return files(spark, path).mapInPandas(run, "raster_id string, nrow int, ncol int, nb int, xmin double, ymax double, xres double, yres double, crs string")


def encode_bands(px: DataFrame, nrow: int, ncol: int, block_rows: int = 512, dtype: str = "float64", nodata: float | None = None, origin=(0.0, 0.0), resolution=(1.0, 1.0), crs: str = "") -> DataFrame:
    """(block, r0, content): a TIFF per block of rows, each placed by its own origin, made in parallel."""
    nb = px.select(F.size("bands").alias("n")).first()["n"]
    flat = px.select("r", "c", *[F.get("bands", F.lit(i)).cast("double").alias(f"b{i}") for i in range(nb)], F.floor(F.col("r") / block_rows).cast("int").alias("block"))

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        r0 = int(key[0]) * block_rows
        empty = nodata if nodata is not None else (np.nan if np.dtype(dtype).kind == "f" else 0)
        image = np.full((nb, min(block_rows, nrow - r0), ncol), empty, dtype)
        for k in range(nb):
            known = t[f"b{k}"].notna().to_numpy()
            image[k, t["r"].to_numpy()[known] - r0, t["c"].to_numpy()[known]] = t[f"b{k}"].to_numpy()[known].astype(dtype)
        content = encode(image, (origin[0], origin[1] - r0 * resolution[1]), resolution, nodata, crs)
        return pd.DataFrame({"block": [int(key[0])], "r0": [r0], "content": [content]})

    return flat.groupBy("block").applyInPandas(run, "block int, r0 int, content binary")


def encode_labels(seg: DataFrame, nrow: int, ncol: int, block_rows: int = 512, **options) -> DataFrame:
    """encode_bands for labels, as 32-bit integers with nodata -2147483648; labels beyond 2^31 - 1 raise."""
    top = seg.agg(F.max("segment_id")).first()[0]
    if top is not None and top > 2**31 - 1:
        raise OverflowError("labels beyond 32 bits; relabel first, or write Parquet")
    return encode_bands(seg.select("r", "c", F.array(F.col("segment_id").cast("double")).alias("bands")), nrow, ncol, block_rows, "int32", -(2**31), **options)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file on any of Spark's file systems: a temporary name first, then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final = hadoop.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(final.getParent())
    part = hadoop.Path(final.getParent(), f".{final.getName()}.part")
    out = fs.create(part, True)
    try:
        out.write(content)
    finally:
        out.close()
    fs.delete(final, True)
    fs.rename(part, final)


def write_geotiff(blocks_table: DataFrame, folder: str, prefix: str = "block") -> None:
    """Writes each row of encode_* as folder/prefix_00000.tif through Spark's file systems; a folder that ends in .tif is the file
    of a single block."""
    for row in blocks_table.toLocalIterator():  # one block in the driver at a time
        write_bytes(blocks_table.sparkSession, folder if folder.lower().endswith((".tif", ".tiff")) else f"{folder}/{prefix}_{row['block']:05d}.tif", bytes(row["content"]))
