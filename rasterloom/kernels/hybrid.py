"""Graph-based superpixels, then mean-shift over the superpixels, for a dense tile."""

from __future__ import annotations

import numpy as np

from rasterloom.kernels.graph import components, first_seen, fh_segment, join_small, neighbor_pairs, valid_pixels


def key_table(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strides and lowest cell so that integer cells, one beyond each end included, become single numbers."""
    cells = np.floor(z).astype(np.int64)
    low = cells.min(axis=0) - 2
    span = cells.max(axis=0) + 3 - low
    strides = np.concatenate([np.cumprod(span[::-1])[::-1][1:], [1]])
    return low, strides


def cell_offsets(dim: int) -> np.ndarray:
    return np.stack(np.meshgrid(*[[-1, 0, 1]] * dim, indexing="ij"), axis=-1).reshape(-1, dim)


class Grid:
    """Points by unit cell."""

    def __init__(self, z: np.ndarray):
        self.low, self.strides = key_table(z)
        keys = self.key(np.floor(z).astype(np.int64))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def key(self, cells: np.ndarray) -> np.ndarray:
        return (cells - self.low) @ self.strides

    def near(self, y: np.ndarray, chunk: int = 500_000):
        """(i, j) for points j in the 3^dim cells around y_i, in pieces."""
        steps = cell_offsets(y.shape[1])
        rows = max(1, chunk // len(steps))
        for lo in range(0, len(y), rows):
            cells = np.floor(y[lo : lo + rows]).astype(np.int64)
            k = self.key(cells[:, None, :] + steps[None]).ravel()
            start, stop = np.searchsorted(self.keys, k), np.searchsorted(self.keys, k, side="right")
            n = stop - start
            of = np.repeat(np.arange(len(k)), n)
            j = self.order[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield lo + of // len(steps), j


def shift_modes(z: np.ndarray, size: np.ndarray, max_iter: int, eps: float) -> np.ndarray:
    """Each point moves to the size-weighted Gaussian mean of the points within 3 units in its neighbouring cells."""
    y = z.copy()
    grid = Grid(z)
    active = np.arange(len(z))
    for _ in range(max_iter):
        now = y[active]
        total, weight = np.zeros_like(now, dtype=np.float64), np.zeros(len(active))
        for i, j in grid.near(now):
            d = z[j] - now[i]
            d2 = np.einsum("ij,ij->i", d, d)
            close = d2 <= 9
            i, j = i[close], j[close]
            v = np.exp(-0.5 * d2[close]) * size[j]
            weight += np.bincount(i, v, minlength=len(active))
            for k in range(z.shape[1]):
                total[:, k] += np.bincount(i, v * z[j, k], minlength=len(active))
        some = weight > 0
        new = now.copy()
        new[some] = (total[some] / weight[some, None]).astype(np.float32)
        d = new - now
        y[active] = new
        active = active[some & (np.einsum("ij,ij->i", d, d) > eps * eps)]
        if not len(active):
            break
    return y


def join_modes(y: np.ndarray, merge: float) -> np.ndarray:
    """The smallest point of each group of modes that are within `merge` of one another, directly or over others."""
    a, b = [], []
    for i, j in Grid(y / np.float32(merge)).near(y / np.float32(merge)):
        d = y[i] - y[j]
        close = (i < j) & (np.einsum("ij,ij->i", d, d) <= np.float32(merge * merge))
        a.append(i[close])
        b.append(j[close])
    return components(len(y), np.concatenate(a), np.concatenate(b))


def hybrid_segment(block: np.ndarray, fh_k: float = 0.5, fh_min_size: int = 20, eight: bool = True, ms_dim: int = 0, ms_ranger: float = 0.15, ms_hs: float = 12.0, ms_max_iter: int = 10, ms_eps: float = 1e-3, mode_merge: float = 0.6, final_min_size: int = 80) -> np.ndarray:
    """Labels 1..K, 0 where a band is missing."""
    if not (ms_ranger > 0 and ms_hs > 0):
        raise ValueError("ms_ranger and ms_hs must be above 0")
    nb, h, w = block.shape
    ok = valid_pixels(block)
    if not ok.any():
        return np.zeros((h, w), np.int64)
    image = block.astype(np.float32).astype(np.float64)
    region = fh_segment(image, fh_k, fh_min_size, eight) - 1
    at = region[ok]
    n = np.bincount(at)
    dim = min(nb, ms_dim or 3, 3)
    r, c = np.nonzero(ok)
    columns = [np.bincount(at, image[k][ok]) / n / ms_ranger for k in range(dim)]
    z = np.column_stack([*columns, np.bincount(at, r) / n / ms_hs, np.bincount(at, c) / n / ms_hs]).astype(np.float32)
    y = shift_modes(z, n, ms_max_iter, ms_eps)
    mode = join_modes(y, mode_merge)
    if final_min_size > 1:
        a, b = neighbor_pairs(h, w, eight)
        flat = np.where(ok, region, -1).ravel()
        ra, rb = flat[a], flat[b]
        keep = (ra >= 0) & (rb >= 0) & (ra != rb)
        pair = np.unique(np.minimum(ra, rb)[keep] * len(n) + np.maximum(ra, rb)[keep])
        ra, rb = pair // len(n), pair % len(n)
        d = y[ra] - y[rb]
        order = np.lexsort((mode[rb], mode[ra], np.einsum("ij,ij->i", d, d)))
        mode = join_small(mode, np.bincount(mode, n, minlength=len(n)).astype(np.int64), mode[ra][order], mode[rb][order], final_min_size)
    labels = np.zeros((h, w), np.int64)
    labels[ok] = mode[at]
    return first_seen(labels, ok)
