"""Best-pair-first merging of a raster of any size: windows segmented by themselves, whose results are proven to be those of the whole.

Merging always takes the least pair of all, and a merge changes only the pairs of its two regions. So the merges inside a set of
pixels that nothing outside ever joins are those of the set alone, in the same order. If S and T are segments side by side and
merging S and T alone ends with S and T, then no pair across them is ever the least, whatever happens elsewhere: it would have
been the least there too. So segments are those of the whole raster if they cover it once and every two that touch stood whole
beside each other in some window.

Each window of the grid is segmented with a halo around it and owns the segments whose first pixel it holds. What it has of
others' segments (where they reach into it or touch its own) must be, pixel by pixel, what their owners have. Windows that
disagree are segmented again with twice the halo, and if that grows too large, as one. Where the effect of a merge reaches far, as in smooth
fields with noise, that ends with one window for the whole raster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.bands import finite
from rasterloom.operators import labels
from rasterloom.plans.scale import Written, broadcast_if_small

#: Cells of a window without its halo, the first halo, and how many times the cells a window has with a halo that grew; about 2 KB of a task's memory a cell.
CELLS, HALO, MOST = 1 << 15, 24, 4
PIXEL, OWNED, SEEN = 0, 1, 2
SCHEMA = "tile_id long, kind byte, r int, c int, id long, digest binary, n long"


def exact_means(px: DataFrame, n: int, cells: int) -> list[float] | None:
    """The bands' means (0 if a band has no values): their exact sums, rounded once, so that neither partitions nor order matter.
    None if no band misses a value in any of the cells."""
    known = px.agg(*[F.count(F.when(finite(F.get("bands", F.lit(i))), 1)).alias(f"n{i}") for i in range(n)]).first()
    if min(known) == cells:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for i in range(n):
                x = batch[i].to_numpy(zero_copy_only=False)
                fraction, power = np.frexp(x[np.isfinite(x)])
                whole = np.ldexp(fraction, 53).astype(np.int64)
                for p in np.unique(power).tolist():
                    part, at = whole[power == p], found.setdefault((i, p), [0, 0])
                    at[0] += int((part >> 26).sum())
                    at[1] += int((part & (1 << 26) - 1).sum())
        rows = [(i, p, *at) for (i, p), at in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("band", "power", "high", "low"), x)) for x in rows], pa.schema([("band", pa.int32()), ("power", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))

    flat = px.select(*[F.get("bands", F.lit(i)).alias(f"b{i}") for i in range(n)])
    parts = flat.mapInArrow(sums, "band int, power int, high long, low long").groupBy("band", "power").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    total = [sum((Fraction((x["high"] << 26) + x["low"]) * Fraction(2) ** (x["power"] - 53) for x in parts if x["band"] == i), Fraction(0)) for i in range(n)]
    return [float(t) / k if k else 0.0 for t, k in zip(total, known)]


def window_rows(label: np.ndarray, bounds: tuple, corner: tuple, nrow: int, ncol: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(each label's id, whether the window owns it, its rows OWNED, its rows SEEN), for labels 0.. in first-seen order.

    A label's id is its first cell in the raster; bounds (r0, r1, c0, c1) of the window without halo, corner (r, c) of label[0, 0].
    Rows are (id, digest, n). A segment of the window that the halo cuts off gives a row without a digest for the cell beyond.
    """
    h, w = label.shape
    r0, r1, c0, c1 = bounds
    top, left = corner
    flat = label.ravel()
    order = np.argsort(flat, kind="stable")
    size = np.bincount(flat)
    start = np.concatenate([[0], np.cumsum(size)])
    cell = lambda k: (k // w + top) * np.int64(ncol) + (k % w + left)
    first = order[start[:-1]]
    fr, fc = first // w + top, first % w + left
    own = (fr >= r0) & (fr < r1) & (fc >= c0) & (fc < c1)
    seen = np.zeros(len(size), bool)
    seen[label[r0 - top : r1 - top, c0 - left : c1 - left]] = True
    for a, b in ((label[:, 1:], label[:, :-1]), (label[1:], label[:-1])):
        seen[a[own[b]]] = True
        seen[b[own[a]]] = True
    cells = cell(order)
    digest = lambda k: hashlib.blake2b(cells[start[k] : start[k + 1]].tobytes(), digest_size=16).digest()
    ids = cells[start[:-1]]
    owned = [(int(ids[k]), digest(k), int(size[k])) for k in np.flatnonzero(own).tolist()]
    others = [(int(ids[k]), digest(k), int(size[k])) for k in np.flatnonzero(seen & ~own).tolist()]
    beyond: set[int] = set()
    r, c = np.arange(h) + top, np.arange(w) + left
    for there, line, at in ((top > 0, label[0], (top - 1) * ncol + c), (top + h < nrow, label[-1], (top + h) * ncol + c), (left > 0, label[:, 0], r * ncol + left - 1), (left + w < ncol, label[:, -1], r * ncol + left + w)):
        if there:
            beyond.update(at[own[line]].tolist())
    return ids, own, owned, others + [(k, None, 0) for k in sorted(beyond)]


class Grid:
    """The windows: blocks of base tiles of h x w cells, each with its halo. Numbers of windows are not used again."""

    def __init__(self, nrow: int, ncol: int, cells: int, halo: int, most: int):
        self.nrow, self.ncol, self.limit = nrow, ncol, cells * most
        side = max(1, int(cells**0.5))
        self.h = min(nrow, max(side, cells // min(ncol, side)))
        self.w = min(ncol, max(1, cells // self.h))
        self.down, self.across, self.halo = -(-nrow // self.h), -(-ncol // self.w), halo
        self.owner = np.arange(self.down * self.across).reshape(self.down, self.across)
        self.later: dict[int, tuple[tuple, int]] = {}  # windows made since: base tiles (i0, i1, j0, j1) and halo
        self.next = self.down * self.across

    def at(self, k: int) -> tuple[tuple, int]:
        i, j = divmod(k, self.across)
        return self.later.get(k) or ((i, i + 1, j, j + 1), self.halo)

    def inner(self, k: int) -> tuple:
        i0, i1, j0, j1 = self.at(k)[0]
        return i0 * self.h, min(self.nrow, i1 * self.h), j0 * self.w, min(self.ncol, j1 * self.w)

    def outer(self, k: int) -> tuple:
        (r0, r1, c0, c1), halo = self.inner(k), self.at(k)[1]
        return max(0, r0 - halo), min(self.nrow, r1 + halo), max(0, c0 - halo), min(self.ncol, c1 + halo)

    def add(self, block: tuple, halo: int) -> int:
        k, self.next = self.next, self.next + 1
        self.later[k] = (block, halo)
        self.owner[block[0] : block[1], block[2] : block[3]] = k
        return k

    def settle(self, pairs: set[tuple[int, int]]) -> tuple[set[int], set[int]]:
        """(windows that go, windows to segment) for windows that disagree: twice the halo where that fits, else two at a time as one."""
        gone: set[int] = set()
        new: set[int] = set()
        wider = {}
        for k in {k for p in pairs for k in p}:
            halo = max(1, 2 * self.at(k)[1])
            r0, r1, c0, c1 = self.inner(k)
            if (min(self.nrow, r1 + halo) - max(0, r0 - halo)) * (min(self.ncol, c1 + halo) - max(0, c0 - halo)) <= self.limit:
                wider[k] = halo
        for a, b in sorted(pairs):
            if a == b or a in wider or b in wider or a in gone or b in gone:
                continue
            block, inside = self.at(a)[0], {a, b}
            while True:  # the rectangle around all windows that it meets
                blocks = [self.at(k)[0] for k in inside]
                block = (min(x[0] for x in blocks), max(x[1] for x in blocks), min(x[2] for x in blocks), max(x[3] for x in blocks))
                met = set(np.unique(self.owner[block[0] : block[1], block[2] : block[3]]).tolist())
                if met == inside:
                    break
                inside = met
            halo = max(self.at(k)[1] for k in inside)
            gone |= inside - new
            new -= inside
            new.add(self.add(block, halo))
        for k, halo in wider.items():
            if k not in gone:
                gone.add(k)
                new.add(self.add(self.at(k)[0], halo))
        return gone, new


def deal(px: DataFrame, n: int, grid: Grid, some: set[int] | None) -> DataFrame:
    """(tile_id, r, c, b0..) of the pixels of each window with its halo, and a row with r = -1 for each window, as some have no pixels."""
    spark = px.sparkSession
    bands = [F.get("bands", F.lit(i)).alias(f"b{i}") for i in range(n)]
    if some is None:

        def reach(x: str, size: int, last: int) -> Column:
            return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - grid.halo) / size)), F.least(F.lit(last - 1), F.floor((F.col(x) + grid.halo) / size))))

        t = px.select("r", "c", *bands).withColumn("i", reach("r", grid.h, grid.down)).withColumn("j", reach("c", grid.w, grid.across))
        t = t.where((F.col("r") < (F.col("i") + 1) * grid.h + grid.halo) & (F.col("c") < (F.col("j") + 1) * grid.w + grid.halo))
        t = t.select((F.col("i") * grid.across + F.col("j")).cast("long").alias("tile_id"), "r", "c", *[f"b{i}" for i in range(n)])
        every = spark.range(grid.down * grid.across).select(F.col("id").alias("tile_id"))
        count = grid.down * grid.across
    else:
        rows = []
        for k in sorted(some):
            r0, r1, c0, c1 = grid.outer(k)
            rows += [(i, j, k, r0, r1, c0, c1) for i in range(r0 // grid.h, (r1 - 1) // grid.h + 1) for j in range(c0 // grid.w, (c1 - 1) // grid.w + 1)]
        table = spark.createDataFrame(rows, "i long, j long, tile_id long, r0 int, r1 int, c0 int, c1 int")
        t = px.select("r", "c", *bands, F.floor(F.col("r") / grid.h).alias("i"), F.floor(F.col("c") / grid.w).alias("j")).join(broadcast_if_small(table), ["i", "j"])
        t = t.where("r >= r0 and r < r1 and c >= c0 and c < c1").select("tile_id", "r", "c", *[f"b{i}" for i in range(n)])
        every = spark.createDataFrame([(k,) for k in sorted(some)], "tile_id long")
        count = len(some)
    marks = every.select("tile_id", F.lit(-1).alias("r"), F.lit(-1).alias("c"), *[F.lit(None).cast("double").alias(f"b{i}") for i in range(n)])
    return t.unionByName(marks).repartition(max(1, min(2 * count, 4096)), "tile_id")


def segmented(px: DataFrame, n: int, grid: Grid, some: set[int] | None, fill: list[float] | None, fun: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """SCHEMA: pixels of the segments that windows own, and the segments that they own and see. some: the windows, or None for the first grid."""
    windows = None if some is None else {k: (grid.inner(k), grid.outer(k)) for k in some}
    h, w, across, nrow, ncol, halo = grid.h, grid.w, grid.across, grid.nrow, grid.ncol, grid.halo

    def one(key: tuple, t: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        if windows is None:
            i, j = divmod(tile, across)
            inner = (i * h, min(nrow, (i + 1) * h), j * w, min(ncol, (j + 1) * w))
            outer = (max(0, inner[0] - halo), min(nrow, inner[1] + halo), max(0, inner[2] - halo), min(ncol, inner[3] + halo))
        else:
            inner, outer = windows[tile]
        t = t.filter(pc.greater_equal(t["r"], 0))
        block = np.full((n, outer[1] - outer[0], outer[3] - outer[2]), np.nan)
        r, c = t["r"].to_numpy() - outer[0], t["c"].to_numpy() - outer[2]
        for k in range(n):
            block[k, r, c] = t[f"b{k}"].to_numpy()
            if fill is not None:
                block[k][np.isnan(block[k])] = fill[k]
        label = fun(block) - 1
        ids, own, owned, others = window_rows(label, inner, (outer[0], outer[2]), nrow, ncol)
        of = label[r, c]
        mine = own[of]
        r, c, of = r[mine] + outer[0], c[mine] + outer[2], of[mine]
        more = owned + others
        m = len(of)
        none = lambda k: np.zeros(k, bool)
        pad = lambda x, kind: pa.array(np.concatenate([x, np.zeros(len(more), x.dtype)]), kind, mask=np.concatenate([none(m), ~none(len(more))]))
        return pa.table({
            "tile_id": pa.array(np.full(m + len(more), tile)), "kind": pa.array(np.repeat([PIXEL, OWNED, SEEN], [m, len(owned), len(others)]).astype(np.int8)),
            "r": pad(r, pa.int32()), "c": pad(c, pa.int32()), "id": pa.array(np.concatenate([ids[of], np.array([x[0] for x in more], np.int64)])),
            "digest": pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([x[1] for x in more], pa.binary())]),
            "n": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array([x[2] for x in more], pa.int64())]),
        })

    return deal(px, n, grid, some).groupBy("tile_id").applyInArrow(one, SCHEMA)


def best_first(px: DataFrame, nrow: int, ncol: int, n: int, fun: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(r, c, segment_id) of px, of n bands, as fun, which merges the best pair first, has them of the whole raster, missing values being the
    band's mean; labels 1..K in first-seen order. A task holds a window: MOST x CELLS cells at most, or more where segments are too large for that."""
    source = Written(px.select("r", "c", "bands"), "window-pixels")
    fill = exact_means(source.df, n, nrow * ncol)
    grid = Grid(nrow, ncol, CELLS, HALO, MOST)
    rounds: list[Written] = []
    some, gone = None, set()
    while True:
        rounds.append(Written(segmented(source.df, n, grid, some, fill, fun), "windows"))
        found = rounds[0].df
        for t in rounds[1:]:
            found = found.unionByName(t.df)
        found = found.where(~F.col("tile_id").isin(sorted(gone))) if gone else found
        owned = found.where(F.col("kind") == OWNED)
        seen = found.where(F.col("kind") == SEEN).select("tile_id", "id", "digest")
        apart = seen.join(owned.select("id", "digest"), ["id", "digest"], "left_anti")
        i, j = F.floor(F.floor(F.col("id") / ncol) / grid.h), F.floor(F.pmod("id", F.lit(ncol)) / grid.w)
        apart = apart.select("tile_id", i.cast("int").alias("i"), j.cast("int").alias("j")).distinct().collect()
        if not apart:
            if owned.agg(F.sum("n")).first()[0] == nrow * ncol:
                break
            block = (0, grid.down, 0, grid.across)  # segments that overlap unseen: not known to happen
            gone, some = gone | set(np.unique(grid.owner).tolist()), {grid.add(block, grid.halo)}
        else:
            old, some = grid.settle({tuple(sorted((x["tile_id"], int(grid.owner[x["i"], x["j"]])))) for x in apart})
            gone |= old
    source.drop()
    mapping = labels.ranked(owned.select(F.col("id").alias("old_id")), "old_id").select("old_id", F.col("rank").alias("new_id"))
    out = Written(labels.apply_merge_map(found.where(F.col("kind") == PIXEL).select("r", "c", F.col("id").alias("segment_id")), mapping), "segments")
    for t in rounds:
        t.drop()
    return out.df
