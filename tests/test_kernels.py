"""Kernels against plain versions written from their definitions, and what must hold for any segmentation."""

from itertools import product

import numpy as np
import pytest

from rasterloom.kernels import baatz, graph, hybrid, meanshift, seeds

ALL = {
    "fh": lambda x: graph.fh_segment(x, 1.0, 8),
    "hybrid": lambda x: hybrid.hybrid_segment(x, final_min_size=10, fh_min_size=4),
    "meanshift": lambda x: meanshift.meanshift_segment(x, 2, 1.0, min_size=5),
    "baatz": lambda x: baatz.baatz_segment(x, 3.0),
    "baatz_fast": lambda x: baatz.baatz_fast_segment(x, 3.0),
    "seeds": lambda x: seeds.seeds_segment(x, step=5, nbins=6),
}


def image(h=18, w=13, nb=2, seed=0, missing=0):
    rng = np.random.default_rng(seed)
    base = np.kron(rng.integers(0, 5, (nb, -(-h // 6), -(-w // 6))), np.ones((1, 6, 6)))[:, :h, :w]
    out = base + rng.normal(0, 0.3, (nb, h, w))
    for _ in range(missing):
        out[rng.integers(nb), rng.integers(h), rng.integers(w)] = np.nan
    return out


def same_partition(a, b):
    pairs = set(zip(a.ravel().tolist(), b.ravel().tolist()))
    return len(pairs) == len(set(a.ravel().tolist())) == len(set(b.ravel().tolist()))


@pytest.mark.parametrize("name", ALL)
@pytest.mark.parametrize("shape", [(18, 13), (1, 9), (9, 1), (1, 1), (20, 31)])
def test_invariants(name, shape):
    x = image(*shape, seed=3)
    got = ALL[name](x)
    assert got.shape == shape and got.min() >= 1
    if name != "seeds":
        assert sorted(set(got.ravel())) == list(range(1, got.max() + 1))
        first = [got.ravel().tolist().index(k) for k in range(1, got.max() + 1)]
        assert first == sorted(first)
    assert np.array_equal(got, ALL[name](x))


@pytest.mark.parametrize("name", ["fh", "hybrid", "meanshift"])
def test_missing_pixels_have_no_label(name):
    x = image(missing=20)
    assert np.array_equal(ALL[name](x) > 0, np.isfinite(x).all(axis=0))
    assert (ALL[name](np.full((2, 4, 4), np.nan)) == 0).all()


@pytest.mark.parametrize("name", ["baatz", "baatz_fast", "seeds"])
def test_missing_pixels_are_labelled(name):
    assert (ALL[name](image(missing=20)) > 0).all()


def plain_fh(x, k, min_size, eight):
    nb, h, w = x.shape
    ok = np.isfinite(x).all(axis=0)
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)][: 4 if eight else 2]
    edges = []
    for r, c in product(range(h), range(w)):
        for dr, dc in steps:
            y, z = r + dr, c + dc
            if 0 <= y < h and 0 <= z < w and ok[r, c] and ok[y, z]:
                edges.append((np.float32(np.sqrt(((x[:, r, c] - x[:, y, z]) ** 2).sum())), r * w + c, y * w + z))
    edges.sort()
    group = {p: {p} for p in range(h * w)}
    inner = {p: np.float32(0) for p in range(h * w)}
    for rule in ("compare", "small"):
        for weight, a, b in edges:
            ga, gb = group[a], group[b]
            if ga is gb:
                continue
            ia, ib = inner[min(ga)], inner[min(gb)]
            if rule == "compare":
                join = weight <= min(ia + np.float32(k) / np.float32(len(ga)), ib + np.float32(k) / np.float32(len(gb)))
            else:
                join = min_size > 1 and (len(ga) < min_size or len(gb) < min_size)
            if join:
                union = ga | gb
                inner[min(union)] = max(ia, ib, weight)
                for p in union:
                    group[p] = union
    out = np.array([min(group[p]) + 1 for p in range(h * w)]).reshape(h, w)
    out[~ok] = 0
    return out


@pytest.mark.parametrize("seed, eight, k, least", list(product(range(3), (True, False), (0.3, 2.0), (1, 6))))
def test_fh(seed, eight, k, least):
    x = image(seed=seed, missing=5)
    assert same_partition(graph.fh_segment(x, k, least, eight), plain_fh(x, k, least, eight))


def plain_filter(x, radius, ranger, max_iter, eps, eight):
    nb, h, w = x.shape
    ok = np.isfinite(x).all(axis=0)
    sigma = max(1.0, radius / 2)
    out = np.zeros_like(x)
    for r, c in product(range(h), range(w)):
        if not ok[r, c]:
            continue
        y = x[:, r, c].copy()
        for _ in range(max_iter):
            total, weight = y.copy(), 1.0
            for i, j in product(range(-radius, radius + 1), repeat=2):
                if (i == j == 0) or (not eight and abs(i) + abs(j) == 2) or not (0 <= r + i < h and 0 <= c + j < w) or not ok[r + i, c + j]:
                    continue
                q = x[:, r + i, c + j]
                v = np.exp(-(i * i + j * j) / (2 * sigma**2)) * np.exp(-((q - y) ** 2).sum() / (2 * ranger**2))
                if v >= 1e-6:
                    total, weight = total + v * q, weight + v
            new = total / weight
            moved = ((new - y) ** 2).sum()
            y = new
            if moved <= eps * eps:
                break
        out[:, r, c] = y
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_meanshift_filter(eight):
    x = image(12, 9, seed=4, missing=4)
    got = meanshift.meanshift_filter(x, 2, 1.0, 6, 1e-3, eight)
    assert np.allclose(got, plain_filter(x, 2, 1.0, 6, 1e-3, eight), atol=5e-3)
    labels, filtered = meanshift.meanshift_segment(x, 2, 1.0, return_filtered=True, min_size=1)
    assert (filtered[:, ~np.isfinite(x).all(axis=0)] == 0).all() and labels.shape == (12, 9)


def test_meanshift_min_size_joins():
    x = np.zeros((1, 8, 8))
    x[0, 3, 3] = 50
    assert meanshift.meanshift_segment(x, 2, 1.0, min_size=1).max() == 2
    assert meanshift.meanshift_segment(x, 2, 1.0, min_size=3).max() == 1


def region(x, cells, w):
    nb, n = x.shape[0], len(cells)
    r, c = np.array([p // w for p in cells]), np.array([p % w for p in cells])
    v = x[:, r, c]
    sd = np.sqrt(np.maximum(0, (v**2).sum(axis=1) / n - (v.sum(axis=1) / n) ** 2))
    inside = set(cells)
    h = x.shape[1]
    sides = sum(not (0 <= p // w + i < h and 0 <= p % w + j < w and (p // w + i) * w + p % w + j in inside) for p in cells for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    box = 2 * (r.max() - r.min() + c.max() - c.min() + 2)
    return n * sd, n * sides / np.sqrt(n), n * sides / box


def plain_factor(x, a, b, w, color, compact):
    (sa, ca, ma), (sb, cb, mb), (s, c, m) = region(x, a, w), region(x, b, w), region(x, a + b, w)
    return color * (s - sa - sb).sum() + (1 - color) * (compact * (c - ca - cb) + (1 - compact) * (m - ma - mb))


def touching(cells, owner, w, h):
    out = set()
    for p in cells:
        for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            r, c = p // w + i, p % w + j
            if 0 <= r < h and 0 <= c < w and owner[r * w + c] != owner[p]:
                out.add(owner[r * w + c])
    return out


def plain_baatz(x, scale, color, compact, best_first):
    nb, h, w = x.shape
    cells = {p: [p] for p in range(h * w)}
    owner = list(range(h * w))

    def merge(p, q):
        for k in cells[q]:
            owner[k] = p
        cells[p] = cells[p] + cells.pop(q)

    while True:
        named = []
        for p in list(cells):
            # the lower id first, so that a pair's factor is the same from both sides to the last bit
            options = [(plain_factor(x, cells[min(p, q)], cells[max(p, q)], w, color, compact), q) for q in touching(cells[p], owner, w, h)]
            if options and min(options)[0] < scale * scale:
                f, q = min(options)
                named.append((f, p, q))
        if not named:
            break
        if best_first:
            f, p, q = min((f, min(p, q), max(p, q)) for f, p, q in named)
            merge(p, q) if len(cells[p]) >= len(cells[q]) else merge(q, p)
        else:
            for f, p, q in sorted(named):
                if p in cells and q in cells:
                    merge(p, q)
    return np.array(owner).reshape(h, w) + 1


@pytest.mark.parametrize("seed, color", [(0, 0.9), (1, 0.5), (2, 1.0)])
def test_baatz(seed, color):
    x = image(9, 7, seed=seed) + np.random.default_rng(seed).normal(0, 0.01, (2, 9, 7))
    assert same_partition(baatz.baatz_fast_segment(x, 2.5, color, 0.5), plain_baatz(x, 2.5, color, 0.5, True))
    assert same_partition(baatz.baatz_segment(x, 2.5, color, 0.5), plain_baatz(x, 2.5, color, 0.5, False))


def test_baatz_arguments():
    for f in (baatz.baatz_segment, baatz.baatz_fast_segment):
        for bad in ({"band_weights": [1.0]}, {"color_weight": 2.0}, {"compactness": -1}, {"scale_param": 0}):
            with pytest.raises(ValueError):
                f(image(4, 4), **bad)


def plain_seeds(x, step, nbins, sizes, iters, per_label, alpha):
    nb, h, w = x.shape
    q = seeds.quantized(x, nbins)
    across = -(-w // step)
    lab = np.array([[r // step * across + c // step for c in range(w)] for r in range(h)])
    count = lab.max() + 1
    z = seeds.START

    def score(block, k):
        inside = lab == k
        hist = [[((q[b] == i) & inside).sum() for i in range(nbins)] for b in range(nb)]
        n = inside.sum()
        return sum((hist[b][v] + alpha) / (n + alpha * nb * nbins) for b, v in block)

    for bs in sizes:
        for _ in range(iters):
            for _ in range(min(seeds.MOST, max(seeds.LEAST, per_label * count))):
                z = (seeds.A * z + seeds.C) % 2**32
                r, c = divmod(z % (h * w), w)
                own = lab[r, c]
                other = next((lab[y, v] for y, v in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)) if 0 <= y < h and 0 <= v < w and lab[y, v] != own), None)
                if other is None:
                    continue
                y, v = slice(r // bs * bs, r // bs * bs + bs), slice(c // bs * bs, c // bs * bs + bs)
                block = [(b, k) for b in range(nb) for k in q[b, y, v].ravel() if k >= 0]
                if score(block, other) > score(block, own) + 1e-12:
                    lab[y, v][lab[y, v] == own] = other
    return lab + 1


def test_seeds(monkeypatch):
    monkeypatch.setattr(seeds, "LEAST", 150)
    x = image(12, 10, seed=6, missing=3)
    got = seeds.seeds_segment(x, 4, 5, (4, 2, 1), 1, 2, 1.0)
    assert np.array_equal(got, plain_seeds(x, 4, 5, (4, 2, 1), 1, 2, 1.0))


def test_sample_numbers():
    z, expected = seeds.START, []
    for _ in range(250):
        z = (seeds.A * z + seeds.C) % 2**32
        expected.append(z % 91)
    assert np.concatenate(list(seeds.Samples(91, piece=100).take(250))).tolist() == expected


def test_hybrid_region_steps():
    rng = np.random.default_rng(0)
    z, n = rng.normal(0, 2, (150, 4)).astype(np.float32), rng.integers(1, 9, 150)
    y = z.astype(float).copy()
    for i in range(150):
        for _ in range(5):
            near = (np.abs(np.floor(z) - np.floor(y[i])) <= 1).all(axis=1) & (((z - y[i]) ** 2).sum(axis=1) <= 9)
            v = np.exp(-0.5 * ((z[near] - y[i]) ** 2).sum(axis=1)) * n[near]
            new = (v[:, None] * z[near]).sum(axis=0) / v.sum()
            moved = ((new - y[i]) ** 2).sum()
            y[i] = new
            if moved <= 1e-6:
                break
    got = hybrid.shift_modes(z, n, 5, 1e-3)
    assert np.mean(np.abs(got - y).max(axis=1) < 1e-3) > 0.97  # cells at a rounding's edge may differ
    mode = hybrid.join_modes(got, 0.6)
    close = ((got[:, None] - got[None]) ** 2).sum(axis=-1) <= np.float32(0.36)
    for i, j in zip(*np.nonzero(close)):
        assert mode[i] == mode[j]
