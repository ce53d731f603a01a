"""Mean-shift filtering and clustering of a dense tile (Comaniciu and Meer 2002)."""

from __future__ import annotations

import math

import numpy as np

from rasterloom.kernels.graph import components, first_seen, neighbor_pairs, valid_pixels


def offsets(radius: int, eight: bool) -> list[tuple[int, int]]:
    around = range(-radius, radius + 1)
    return [(i, j) for i in around for j in around if (i or j) and (eight or abs(i) + abs(j) != 2)]


def meanshift_filter(block: np.ndarray, radius: int, ranger: float, max_iter: int, eps: float, eight: bool = True) -> np.ndarray:
    """Each valid pixel moves to the weighted mean of its window's original values and itself until it moves by eps or less."""
    nb, h, w = block.shape
    ok = valid_pixels(block)
    sigma = max(1.0, radius / 2)
    wide = w + 2 * radius
    image = np.zeros((h + 2 * radius, wide, nb), np.float32)
    image[radius : radius + h, radius : radius + w] = np.where(ok[..., None], np.moveaxis(block, 0, -1), 0)
    inside = np.zeros((h + 2 * radius, wide), bool)
    inside[radius : radius + h, radius : radius + w] = ok
    image, inside = image.reshape(-1, nb), inside.ravel()
    at = np.flatnonzero(inside)
    result = image[at].copy()
    active = np.arange(len(at))
    steps = [(i * wide + j, np.float32(math.exp(-(i * i + j * j) / (2 * sigma * sigma)))) for i, j in offsets(radius, eight)]
    scale = np.float32(-1 / (2 * ranger * ranger))
    for _ in range(max_iter):
        moved = np.zeros(len(active), bool)
        for lo in range(0, len(active), 1 << 16):  # pieces that stay in the cache
            own = active[lo : lo + (1 << 16)]
            y, p = result[own], at[own]
            total, weight = y.copy(), np.ones(len(own), np.float32)
            for step, ws in steps:
                q = p + step
                x = image[q]
                d = x - y
                v = ws * np.exp(scale * np.einsum("ij,ij->i", d, d))
                v[(v < 1e-6) | ~inside[q]] = 0
                weight += v
                total += v[:, None] * x
            new = total / weight[:, None]
            d = new - y
            result[own] = new
            moved[lo : lo + len(own)] = np.einsum("ij,ij->i", d, d) > np.float32(eps * eps)
        active = active[moved]
        if not len(active):
            break
    out = np.zeros((nb, h * w))
    out[:, ok.ravel()] = result.T
    return out.reshape(nb, h, w)


def join_small_by_window(parent: np.ndarray, filtered: np.ndarray, ok: np.ndarray, radius: int, eight: bool, least: int) -> np.ndarray:
    """In row order, a pixel of a component below `least` joins it to that of the most similar other pixel of its window."""
    nb, h, w = filtered.shape
    size = np.bincount(parent, minlength=h * w).tolist()
    up = parent.tolist()
    values = filtered.reshape(nb, -1).T.astype(np.float32)
    flat = ok.ravel()
    around = np.array(offsets(radius, eight))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    small = np.array(size)[parent] < least
    for p in np.flatnonzero(flat & small).tolist():
        root = find(p)
        if size[root] >= least:
            continue
        r, c = p // w + around[:, 0], p % w + around[:, 1]
        inside = (r >= 0) & (c >= 0) & (r < h) & (c < w)
        q = r[inside] * w + c[inside]
        q = q[flat[q]]
        if not len(q):
            continue
        d = values[q] - values[p]
        for k in np.argsort(np.einsum("ij,ij->i", d, d), kind="stable").tolist():
            other = find(int(q[k]))
            if other != root:
                big, little = (root, other) if size[root] >= size[other] else (other, root)
                up[little] = big
                size[big] += size[little]
                break
    return np.array([find(x) for x in range(h * w)])


def meanshift_segment(block: np.ndarray, spatialr: int = 5, ranger: float = 1.0, max_iter: int = 10, eps: float = 1e-3, merge_thr: float | None = None, min_size: int = 30, eight: bool = True, return_filtered: bool = False):
    """Labels 1..K, 0 where a band is missing; with the filtered bands (0 there) if return_filtered."""
    if not ranger > 0:
        raise ValueError("ranger must be above 0")
    nb, h, w = block.shape
    spatialr, max_iter = max(1, int(spatialr)), max(1, int(max_iter))
    ok = valid_pixels(block)
    filtered = meanshift_filter(block, spatialr, ranger, max_iter, eps, eight)
    limit = merge_thr if merge_thr is not None and merge_thr > 0 else 0.5 * ranger
    a, b = neighbor_pairs(h, w, eight)
    flat = ok.ravel()
    keep = flat[a] & flat[b]
    a, b = a[keep], b[keep]
    values = filtered.reshape(nb, -1).astype(np.float32)
    d2 = ((values[:, a] - values[:, b]) ** 2).sum(axis=0)
    close = d2 <= np.float32(limit * limit)
    parent = components(h * w, a[close], b[close])
    if min_size > 1:
        parent = join_small_by_window(parent, filtered, ok, spatialr, eight, min_size)
    labels = first_seen(parent.reshape(h, w), ok)
    return (labels, filtered) if return_filtered else labels
