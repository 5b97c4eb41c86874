"""Cluster centres of vectors (rows of x), deterministic for a seed. Ties go to the smaller index."""

from __future__ import annotations

import numpy as np

from prismgrid.model import Cluster, FilterSpec


def distances(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] + (mu * mu).sum(1)[None, :] - 2 * x @ mu.T, 0)


def _lloyd(x: np.ndarray, mu: np.ndarray, iterations: int, sigma: float | None = None) -> tuple[np.ndarray, float]:
    """k-means steps; with sigma, points near their centre weigh less: 1 - exp(-d^2 / 2 sigma^2). An empty cluster keeps its centre."""
    mu = mu.copy()
    for _ in range(iterations):
        d = distances(x, mu)
        of = d.argmin(1)
        wt = np.ones(len(x)) if sigma is None else 1 - np.exp(-d[np.arange(len(x)), of] / (2 * sigma * sigma))
        total = np.bincount(of, wt, len(mu))
        new = np.stack([np.bincount(of, wt * x[:, c], len(mu)) for c in range(x.shape[1])], 1)
        ok = total > 1e-12
        new[ok] /= total[ok, None]
        new[~ok] = mu[~ok]
        if np.allclose(new, mu, atol=1e-9, rtol=0):
            mu = new
            break
        mu = new
    return mu, float(distances(x, mu).min(1).sum())


def _seed_pp(x: np.ndarray, k: int, rng: np.random.Generator, trials: int) -> np.ndarray:
    """k-means++ seeds: each draw takes the best of some candidates."""
    mu = [x[rng.integers(len(x))]]
    d = distances(x, np.array(mu))[:, 0]
    while len(mu) < k:
        s = np.cumsum(d)
        if s[-1] <= 0:
            mu.append(mu[-1])
            continue
        draw = np.minimum(np.searchsorted(s, rng.random(max(1, trials)) * s[-1]), len(x) - 1)
        left = [np.minimum(d, distances(x, x[i : i + 1])[:, 0]) for i in draw]
        best = int(np.argmin([v.sum() for v in left]))
        mu.append(x[draw[best]])
        d = left[best]
    return np.array(mu)


def _cut(x: np.ndarray, k: int, median: bool) -> np.ndarray:
    """Boxes split one by one: the widest channel at its median, or the largest variance at its mean."""
    boxes = [x]
    while len(boxes) < k:
        spread = [(np.ptp(b, axis=0).max() if median else b.var(0).sum() * len(b)) if len(b) > 1 else -1.0 for b in boxes]
        i = int(np.argmax(spread))
        if spread[i] <= 0:
            break
        b = boxes.pop(i)
        c = int((np.ptp(b, axis=0) if median else b.var(0)).argmax())
        at = np.median(b[:, c]) if median else b[:, c].mean()
        low = b[:, c] <= at
        if low.all():
            low = b[:, c] < at
        boxes[i:i] = [b[low], b[~low]]
    mu = np.array([np.median(b, axis=0) if median else b.mean(0) for b in boxes])
    return np.concatenate([mu, np.repeat(mu[-1:], k - len(mu), 0)])


def _uniform(x: np.ndarray, k: int) -> np.ndarray:
    """Means of the fullest cells of a regular grid with at least k cells."""
    low, span = x.min(0), np.maximum(np.ptp(x, axis=0), 1e-9)
    per = 1
    while per ** x.shape[1] < k:
        per += 1
    while True:
        cell = np.minimum((x - low) / span * per, per - 1).astype(np.int64)
        _, of, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
        if len(n) >= k or per > 64:
            break
        per += 1
    top = np.argsort(-n, kind="stable")[:k]
    mu = np.array([x[of.ravel() == i].mean(0) for i in top])
    return np.concatenate([mu, np.repeat(mu[-1:], k - len(mu), 0)])


def _bic(x: np.ndarray, mu: np.ndarray) -> float:
    n, dim = x.shape
    k = len(mu)
    if n <= k:
        return -np.inf
    d = distances(x, mu)
    of = d.argmin(1)
    var = max(d.min(1).sum() / (dim * (n - k)), 1e-12)
    size = np.bincount(of, minlength=k)
    fit = sum(s * np.log(s / n) for s in size if s) - n * dim / 2 * np.log(2 * np.pi * var) - dim * (n - k) / 2
    return fit - (k * (dim + 1)) / 2 * np.log(n)


def _x_means(x: np.ndarray, k: int, spec: FilterSpec, rng: np.random.Generator) -> np.ndarray:
    """Two clusters, each split in two while the Bayesian information criterion improves, up to k.

    From two on: of evenly spread clusters the first split alone gains nothing by that criterion.
    """
    mu = x.mean(0, keepdims=True)
    if min(k, len(x)) > 1:
        mu, _ = _lloyd(x, _seed_pp(x, 2, rng, spec.trials), spec.iterations)
    while len(mu) < k:
        of, out = distances(x, mu).argmin(1), []
        for i, centre in enumerate(mu):
            own = x[of == i]
            if len(own) > 3 and len(out) + len(mu) - i < k:
                two, _ = _lloyd(own, _seed_pp(own, 2, rng, spec.trials), spec.iterations)
                if _bic(own, two) > _bic(own, centre[None]):
                    out += list(two)
                    continue
            out.append(centre)
        if len(out) == len(mu):
            break
        mu, _ = _lloyd(x, np.array(out), spec.iterations)
    return mu


def centres(x: np.ndarray, spec: FilterSpec, salt: int = 0) -> np.ndarray:
    """At most spec.k centres of the rows by spec.cluster; salt: another draw of the random methods."""
    rng, k, how = np.random.default_rng([spec.seed, salt]), min(spec.k, len(x)), spec.cluster
    if how == Cluster.RANDOM_SAMPLE:
        return x[np.sort(rng.choice(len(x), k, replace=False))]
    if how == Cluster.QUANTIZE_DIV:
        return _uniform(x, k)
    if how in (Cluster.MEDIANCUT_MEDIAN, Cluster.QUANTIZE_WAN):
        return _cut(x, k, how == Cluster.MEDIANCUT_MEDIAN)
    if how in (Cluster.KMEANS_MEDIANCUT, Cluster.KMEANS_WAN):
        return _lloyd(x, _cut(x, k, how == Cluster.KMEANS_MEDIANCUT), spec.iterations)[0]
    if how == Cluster.X_MEANS:
        return _x_means(x, k, spec, rng)
    best, cost = None, np.inf
    tries = max(1, spec.attempts) * (spec.trials if how == Cluster.KMEANS_MSPP else 1)
    for _ in range(tries):
        seeds = x[np.sort(rng.choice(len(x), k, replace=False))] if how == Cluster.KMEANS else _seed_pp(x, k, rng, spec.trials)
        mu, c = _lloyd(x, seeds, spec.iterations, spec.sigma_cluster if how == Cluster.GAUSS_INV_MEANS_PP else None)
        if best is None or c < cost:
            best, cost = mu, c
    return best
