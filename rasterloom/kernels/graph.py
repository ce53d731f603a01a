"""Graph-based segmentation of a dense tile (Felzenszwalb and Huttenlocher 2004), and helpers that other kernels share."""

from __future__ import annotations

import numpy as np

#: Right, down, down-right, down-left.
STEPS = [(0, 1), (1, 0), (1, 1), (1, -1)]


def valid_pixels(block: np.ndarray) -> np.ndarray:
    return np.isfinite(block).all(axis=0)


def neighbor_pairs(h: int, w: int, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (a, b) of all neighbours in a grid, a before b."""
    cell = np.arange(h * w, dtype=np.int64).reshape(h, w)
    a, b = [], []
    for dr, dc in STEPS[: 4 if eight else 2]:
        first = cell[: h - dr, max(0, -dc) : w - max(0, dc)]
        second = cell[dr:, max(0, dc) : w + min(0, dc)]
        a.append(first.ravel())
        b.append(second.ravel())
    return np.concatenate(a), np.concatenate(b)


def weighted_edges(block: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) between valid pixels in the order (w, a, b); w is a float32 distance."""
    nb, h, w = block.shape
    ok = valid_pixels(block).ravel()
    a, b = neighbor_pairs(h, w, eight)
    keep = ok[a] & ok[b]
    a, b = a[keep], b[keep]
    flat = block.reshape(nb, -1)
    total = np.zeros(len(a))
    for band in flat:
        d = band[a] - band[b]
        total += d * d
    weight = np.sqrt(total).astype(np.float32)
    order = np.lexsort((b, a, weight))
    return a[order], b[order], weight[order]


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = roots(label)
    return label


def first_seen(label: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """1 to the number of labels in the order of first appearance; 0 where not ok."""
    out = np.zeros(label.shape, np.int64)
    _, first, inverse = np.unique(label[ok], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
    out[ok] = rank[inverse]
    return out


def join_small(parent: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Joins, edge by edge, two components if either has fewer than `least` members. Edges between large ones can't count later either, as components only grow."""
    top = roots(parent)
    ra, rb = top[a], top[b]
    keep = (ra != rb) & ((size[ra] < least) | (size[rb] < least))
    up, n = top.tolist(), size.tolist()
    for x, y in zip(ra[keep].tolist(), rb[keep].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y and (n[x] < least or n[y] < least):
            if n[x] < n[y]:
                x, y = y, x
            up[y] = x
            n[x] += n[y]
    return roots(np.array(up))


def graph_regions(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """(parent, size) after scanning edges in order: two components join if the edge is no heavier than either's internal
    difference plus k / size, in float32."""
    slack = np.concatenate([[np.float32(np.inf)], np.float32(k) / np.arange(1, n + 1, dtype=np.float32)])
    near = slack.tolist()
    single = np.float32
    up, size, inner = list(range(n)), [1] * n, [0.0] * n
    for x, y, weight in zip(a.tolist(), b.tolist(), w.tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x == y:
            continue
        sx, sy = size[x], size[y]
        tx, ty = inner[x] + near[sx], inner[y] + near[sy]
        limit = tx if tx < ty else ty
        if abs(weight - limit) <= 1e-6 * limit:  # as close as float32 rounding: compare in float32
            limit = float(min(single(inner[x]) + slack[sx], single(inner[y]) + slack[sy]))
        if weight <= limit:
            if sx < sy:
                x, y = y, x
            up[y] = x
            size[x] = sx + sy
            inner[x] = weight if weight > inner[x] and weight > inner[y] else max(inner[x], inner[y])
    return np.array(up), np.array(size)


def fh_segment(block: np.ndarray, k: float = 1.0, min_size: int = 50, eight: bool = True) -> np.ndarray:
    """Labels 1..K, 0 where a band is missing."""
    if not k > 0:
        raise ValueError("k must be above 0")
    nb, h, w = block.shape
    a, b, weight = weighted_edges(block, eight)
    parent, size = graph_regions(h * w, a, b, weight, k)
    parent = join_small(parent, size, a, b, min_size) if min_size > 1 else roots(parent)
    return first_seen(parent.reshape(h, w), valid_pixels(block))
