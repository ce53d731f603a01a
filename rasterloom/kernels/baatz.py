"""Multiresolution region merging (Baatz and Schaepe 2000) of a dense tile: in rounds, and best pair first. 4 neighbours.

A region is its pixel count, sums, sums of squares, perimeter and bounding box; merging adds them, less twice the shared
sides for the perimeter.
"""

from __future__ import annotations

import heapq
from math import fsum, sqrt

import numpy as np

from rasterloom.kernels.graph import first_seen, neighbor_pairs, roots


def filled(block: np.ndarray) -> np.ndarray:
    """Missing values become the band's mean (0 if a band has none), of the exact sum, as windows of a raster have it."""
    out = block.astype(float).copy()
    for band in out:
        missing = np.isnan(band)
        if missing.any():
            band[missing] = 0.0 if missing.all() else fsum(band[~missing]) / (~missing).sum()
    return out


def checked(nb: int, scale_param: float, color_weight: float, compactness: float, band_weights) -> np.ndarray:
    weights = np.ones(nb) if band_weights is None else np.asarray(band_weights, float)
    if len(weights) != nb:
        raise ValueError("band_weights must have one value per band")
    if not (0 <= color_weight <= 1 and 0 <= compactness <= 1 and scale_param > 0):
        raise ValueError("weights must be in 0..1 and scale_param above 0")
    return weights


def heterogeneity(n, total, squares, weights):
    """n x sd, weighted over bands (last axis)."""
    mean = total / n[..., None]
    return (np.sqrt(np.maximum(0.0, squares / n[..., None] - mean * mean)) * weights).sum(axis=-1) * n


def shape_parts(n, perimeter, box):
    half = 2.0 * (box[..., 1] - box[..., 0] + box[..., 3] - box[..., 2] + 2)
    return np.sqrt(n) * perimeter, n * perimeter / half


def fusion_factors(s: dict, a, b, shared, weights, color_weight, compactness):
    """The growth in heterogeneity by merging regions a and b."""
    n = s["n"][a] + s["n"][b]
    box = np.concatenate([np.minimum(s["box"][a], s["box"][b])[:, [0]], np.maximum(s["box"][a], s["box"][b])[:, [1]], np.minimum(s["box"][a], s["box"][b])[:, [2]], np.maximum(s["box"][a], s["box"][b])[:, [3]]], axis=1)
    color = heterogeneity(n, s["sum"][a] + s["sum"][b], s["sq"][a] + s["sq"][b], weights) - s["h"][a] - s["h"][b]
    compact, smooth = shape_parts(n, s["perimeter"][a] + s["perimeter"][b] - 2 * shared, box)
    shape = compactness * (compact - s["compact"][a] - s["compact"][b]) + (1 - compactness) * (smooth - s["smooth"][a] - s["smooth"][b])
    return color_weight * color + (1 - color_weight) * shape


def baatz_segment(block: np.ndarray, scale_param: float = 50, color_weight: float = 0.9, compactness: float = 0.5, band_weights=None) -> np.ndarray:
    """Rounds: every region names its best neighbour; pairs below scale_param^2 merge from the least factor on if both regions
    are still there, on the factors of the round's start. Labels 1..K in first-seen order."""
    nb, h, w = block.shape
    weights = checked(nb, scale_param, color_weight, compactness, band_weights)
    x = filled(block).reshape(nb, -1).T
    r, c = np.divmod(np.arange(h * w), w)
    s = {"n": np.ones(h * w), "sum": x.copy(), "sq": x * x, "perimeter": np.full(h * w, 4.0), "box": np.column_stack([r, r, c, c]).astype(float)}
    a, b = neighbor_pairs(h, w, False)
    shared = np.ones(len(a))
    label = np.arange(h * w)
    limit = scale_param * scale_param
    while len(a):
        count = len(s["n"])
        s["h"] = heterogeneity(s["n"], s["sum"], s["sq"], weights)
        s["compact"], s["smooth"] = shape_parts(s["n"], s["perimeter"], s["box"])
        ff = np.concatenate([fusion_factors(s, a[i : i + 400_000], b[i : i + 400_000], shared[i : i + 400_000], weights, color_weight, compactness) for i in range(0, len(a), 400_000)])
        below = ff < limit
        one, two, f = np.concatenate([a[below], b[below]]), np.concatenate([b[below], a[below]]), np.concatenate([ff[below]] * 2)
        order = np.lexsort((two, f, one))
        one, two, f = one[order], two[order], f[order]
        best = np.concatenate([[True], one[1:] != one[:-1]]) if len(one) else np.zeros(0, bool)
        one, two, f = one[best], two[best], f[best]
        if not len(one):
            break
        order = np.lexsort((one, f))
        there, up = [True] * count, list(range(count))
        for p, q in zip(one[order].tolist(), two[order].tolist()):
            if there[p] and there[q]:
                there[q] = False
                up[q] = p
        top = roots(np.array(up))
        kept = np.flatnonzero(np.array(there))
        number = np.zeros(count, np.int64)
        number[kept] = np.arange(len(kept))
        to = number[top]
        ta, tb = to[a], to[b]
        inner = ta == tb
        perimeter = np.bincount(to, s["perimeter"], minlength=len(kept)) - 2 * np.bincount(ta[inner], shared[inner], minlength=len(kept))
        box = np.empty((len(kept), 4))
        for k, ufunc in enumerate((np.minimum, np.maximum, np.minimum, np.maximum)):
            box[:, k] = np.inf if ufunc is np.minimum else -np.inf
            ufunc.at(box[:, k], to, s["box"][:, k])
        add = lambda m: np.column_stack([np.bincount(to, m[:, k], minlength=len(kept)) for k in range(nb)])
        s = {"n": np.bincount(to, s["n"], minlength=len(kept)), "sum": add(s["sum"]), "sq": add(s["sq"]), "perimeter": perimeter, "box": box}
        key = np.minimum(ta, tb)[~inner] * len(kept) + np.maximum(ta, tb)[~inner]
        pair, inverse = np.unique(key, return_inverse=True)
        a, b, shared = pair // len(kept), pair % len(kept), np.bincount(inverse, shared[~inner], minlength=len(pair))
        label = to[label]
    return first_seen(label.reshape(h, w), np.ones((h, w), bool))


def baatz_fast_segment(block: np.ndarray, scale_param: float = 50, color_weight: float = 0.9, compactness: float = 0.5, band_weights=None) -> np.ndarray:
    """Best pair first: the pair with the least factor of all merges, as long as it is below scale_param^2. Labels 1..K in first-seen order."""
    nb, h, w = block.shape
    weights = checked(nb, scale_param, color_weight, compactness, band_weights).tolist()
    x = filled(block).reshape(nb, -1).T
    count = h * w
    r, c = np.divmod(np.arange(count), w)
    a, b = neighbor_pairs(h, w, False)
    s = {"n": np.ones(count), "sum": x, "sq": x * x, "perimeter": np.full(count, 4.0), "box": np.column_stack([r, r, c, c]).astype(float)}
    s["h"] = heterogeneity(s["n"], s["sum"], s["sq"], np.array(weights))
    s["compact"], s["smooth"] = shape_parts(s["n"], s["perimeter"], s["box"])
    first = fusion_factors(s, a, b, np.ones(len(a)), np.array(weights), color_weight, compactness)
    limit = scale_param * scale_param
    some = first < limit
    heap = list(zip(first[some].tolist(), a[some].tolist(), b[some].tolist(), [0] * int(some.sum()), [0] * int(some.sum())))
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    # a region: pixels, perimeter, box, n x sd, sqrt(n) x perimeter, n x perimeter / box perimeter; sums and squares by band
    regions = [(1, 4, p, p, q, q, 0.0, 4.0, 1.0) for p, q in zip(r.tolist(), c.tolist())]
    total, squares = x.tolist(), (x * x).tolist()
    stamp, up = [0] * count, list(range(count))
    near: list[dict[int, int] | None] = [{} for _ in range(count)]
    for p, q in zip(a.tolist(), b.tolist()):
        near[p][q] = 1
        near[q][p] = 1
    smooth_weight, shape_weight = 1 - compactness, 1 - color_weight
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        _, p, q, vp, vq = pop(heap)
        if stamp[p] != vp or stamp[q] != vq:
            continue
        if regions[p][0] < regions[q][0]:
            p, q = q, p
        links, gone = near[p], near[q]
        sides = links.pop(q)
        n, around, a0, a1, a2, a3, *_ = regions[p]
        m, edge, b0, b1, b2, b3, *_ = regions[q]
        n += m
        around += edge - 2 * sides
        a0, a1, a2, a3 = min(a0, b0), max(a1, b1), min(a2, b2), max(a3, b3)
        sums = total[p] = [u + v for u, v in zip(total[p], total[q])]
        squared = squares[p] = [u + v for u, v in zip(squares[p], squares[q])]
        spread = sum(weight * sqrt(max(0.0, n * v - u * u)) for u, v, weight in zip(sums, squared, weights))
        compact, smooth = sqrt(n) * around, n * around / (2 * (a1 - a0 + a3 - a2 + 2))
        regions[p] = (n, around, a0, a1, a2, a3, spread, compact, smooth)
        up[q] = p
        for k, sides in gone.items():
            if k != p:
                links[k] = links.get(k, 0) + sides
                other = near[k]
                del other[q]
                other[p] = links[k]
        near[q] = None
        vp = stamp[p] = stamp[p] + 1
        stamp[q] = -1
        for k, sides in links.items():  # the factors of the new region's pairs
            m, edge, b0, b1, b2, b3, spread_k, compact_k, smooth_k = regions[k]
            m += n
            edge += around - 2 * sides
            color = 0.0
            for u, v, u2, v2, weight in zip(sums, total[k], squared, squares[k], weights):
                u += v
                v = m * (u2 + v2) - u * u  # the square of n x sd
                if v > 0:
                    color += weight * sqrt(v)
            half = 2 * ((a1 if a1 > b1 else b1) - (a0 if a0 < b0 else b0) + (a3 if a3 > b3 else b3) - (a2 if a2 < b2 else b2) + 2)
            f = color_weight * (color - spread - spread_k) + shape_weight * (compactness * (sqrt(m) * edge - compact - compact_k) + smooth_weight * (m * edge / half - smooth - smooth_k))
            if f < limit:
                push(heap, (f, p, k, vp, stamp[k]) if p < k else (f, k, p, stamp[k], vp))
    return first_seen(roots(np.array(up)).reshape(h, w), np.ones((h, w), bool))
