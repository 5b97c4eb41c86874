"""Permutohedral lattice and Gaussian KD-tree: the filter as splat, blur and slice in position space."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(77)
_MIX = (_RNG.integers(1, 2**62, 512, dtype=np.int64) * 2 + 1).astype(np.int64)


def positions(g: np.ndarray, sigma_space: float, sigma_range: float) -> np.ndarray:
    """(x, y, guide) of each pixel in units of the sigmas."""
    h, w = g.shape[:2]
    y, x = np.mgrid[:h, :w]
    return np.concatenate([(x / sigma_space)[..., None], (y / sigma_space)[..., None], g / sigma_range], axis=2).reshape(h * w, -1)


def permutohedral(p: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Rows f smoothed by a unit Gaussian over positions p (Adams, Baek and Davis, 2010)."""
    n, d = p.shape
    scale = (d + 1) * np.sqrt(2 / 3) / np.sqrt((np.arange(d) + 1) * (np.arange(d) + 2))
    x = p * scale
    # into the plane whose coordinates sum to zero
    above = np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    e = np.empty((n, d + 1))
    e[:, 0] = above[:, 0]
    for i in range(1, d + 1):
        e[:, i] = (above[:, i] if i < d else 0) - i * x[:, i - 1]
    # the nearest remainder-0 point, and the order of the rest
    r = np.rint(e / (d + 1)) * (d + 1)
    s = np.rint(r.sum(1) / (d + 1)).astype(int)
    rank = np.argsort(np.argsort(-(e - r), axis=1, kind="stable"), axis=1) + s[:, None]
    low, high = rank < 0, rank > d
    rank = rank + (d + 1) * low - (d + 1) * high
    r = r + (d + 1) * low - (d + 1) * high
    # barycentric coordinates
    t = (e - r) / (d + 1)
    b = np.zeros((n, d + 2))
    rows = np.arange(n)[:, None]
    np.add.at(b, (rows, d - rank), t)
    np.subtract.at(b, (rows, d + 1 - rank), t)
    b[:, 0] += 1 + b[:, d + 1]
    # vertices are named by a linear hash of their first d coordinates, so neighbours' names follow
    m = _MIX[:d]
    base = (r[:, :d].astype(np.int64) * m).sum(1)
    names = np.empty((n, d + 1), np.int64)
    for k in range(d + 1):
        names[:, k] = base + (np.where(rank[:, :d] <= d - k, k, k - (d + 1)).astype(np.int64) * m).sum(1)
    keys, of = np.unique(names.ravel(), return_inverse=True)
    of = of.reshape(n, d + 1)
    ones = np.concatenate([f, np.ones((n, 1))], axis=1)
    v = np.stack([np.bincount(of.ravel(), (b[:, : d + 1] * ones[:, c : c + 1]).ravel(), len(keys)) for c in range(ones.shape[1])], 1)
    for a in range(d + 1):
        step = np.ones(d, np.int64)
        if a < d:
            step[a] = -d
        step = (step * m).sum()
        near = []
        for sign in (1, -1):
            want = keys + sign * step
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            near.append(np.where((keys[at] == want)[:, None], v[at], 0))
        v = 0.5 * v + 0.25 * (near[0] + near[1])
    out = np.einsum("nk,nkc->nc", b[:, : d + 1], v[of])
    return out[:, :-1] / np.maximum(out[:, -1:], 1e-12)


def kd_tree(p: np.ndarray, f: np.ndarray, diagonal: float = 1.0, reach: float = 3.0) -> np.ndarray:
    """Rows f smoothed by a unit Gaussian over positions p, by the leaves of a KD-tree (after Adams et al., 2009).

    Boxes are halved across their widest side until their diagonal is about a standard
    deviation; a leaf stands at its mean. Every leaf within reach takes part, with weights
    exp(-d^2/2s^2) for s^2 = 1/4 to splat and slice and 1/2 to blur.
    """
    leaves, stack = [], [np.arange(len(p))]
    while stack:
        at = stack.pop()
        low, high = p[at].min(0), p[at].max(0)
        if np.linalg.norm(high - low) <= diagonal or len(at) == 1:
            leaves.append(at)
            continue
        c = int(np.argmax(high - low))
        left = p[at, c] <= (low[c] + high[c]) / 2
        stack += [at[~left], at[left]]
    mu = np.array([p[at].mean(0) for at in leaves])
    ones = np.concatenate([f, np.ones((len(p), 1))], axis=1)
    c = int(np.argmax(np.ptp(p, axis=0)))  # only leaves in reach along the longest side are looked at
    mu = mu[np.argsort(mu[:, c], kind="stable")]

    def near(a: np.ndarray, var: float):
        """(rows of a, leaves, their weights) in pieces; a pixel's own leaf is always in reach."""
        order = np.argsort(a[:, c], kind="stable")
        far = reach * np.sqrt(var)
        for i in range(0, len(a), 512):
            rows = order[i : i + 512]
            x = a[rows]
            lo, hi = np.searchsorted(mu[:, c], [x[0, c] - far, x[-1, c] + far])
            m = mu[lo:hi]
            d = np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * x @ m.T, 0)
            yield rows, slice(lo, hi), np.where(d <= far * far, np.exp(-d / (2 * var)), 0)

    v = np.zeros((len(mu), ones.shape[1]))
    for rows, at, w in near(p, 0.25):
        v[at] += (w / np.maximum(w.sum(1, keepdims=True), 1e-300)).T @ ones[rows]
    blurred = np.zeros_like(v)
    for rows, at, w in near(mu, 0.5):
        blurred[rows] = w @ v[at]
    out = np.empty_like(f)
    for rows, at, w in near(p, 0.25):
        o = w @ blurred[at]
        out[rows] = o[:, :-1] / np.maximum(o[:, -1:], 1e-300)
    return out
