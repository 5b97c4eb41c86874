"""Constant-time forms of the filter over one padded block: the range kernel as a sum of K components.

Nystrom: with centres mu, C[p,k] the kernel between pixel and centre and B = V L V' that
between centres, phi = C V; out = sum_j phi_j GF[phi_j f] / L_j over the same with f = 1,
GF being the spatial Gaussian. Soft and interpolation blend the K images
h_k = GF[C_k f] / GF[C_k] by each pixel's distance to the centres.
"""

from __future__ import annotations

import numpy as np

from prismgrid.functions import kernels
from prismgrid.functions.clustering import centres, distances
from prismgrid.model import Border, FilterSpec, Sampler, Variant, scale_of

_LEAST = 1e-6


def sample(g: np.ndarray, spec: FilterSpec, salt: int = 0) -> np.ndarray:
    """The rows of g (an image) that take part in clustering."""
    flat, s = g.reshape(-1, g.shape[2]), scale_of(spec.rate)
    if spec.sampler in (Sampler.NEAREST, Sampler.GRADIENT_MAX, Sampler.CUBIC) and s == 1:
        return flat
    h, w = g.shape[:2]
    if spec.sampler == Sampler.NEAREST:
        return g[::s, ::s].reshape(-1, g.shape[2])
    if spec.sampler == Sampler.CUBIC:
        return cubic(g, s).reshape(-1, g.shape[2])
    edge = kernels.gradient(kernels.padded(g, 1, Border.REFLECT101))
    if spec.sampler == Sampler.GRADIENT_MAX:
        y, x = np.divmod(np.arange(h * w), w)
        block = y // s * -(-w // s) + x // s
        order = np.lexsort((x, y, -edge.ravel(), block))
        return flat[order[np.r_[True, np.diff(block[order]) > 0]]]
    if spec.sampler == Sampler.DITHER_DOG:
        edge = dog(g, spec.sigma_space)
    if spec.sampler == Sampler.IMPORTANCE_MAP:
        chance = np.full(edge.shape, spec.rate) if edge.mean() <= 0 else edge * (spec.rate / edge.mean())
        mask = np.random.default_rng([spec.seed, salt, 1]).random(edge.shape) < chance
    else:
        mask = kernels.diffuse(edge, spec.rate)
    out = flat[mask.ravel()]
    return out if len(out) >= min(spec.k, len(flat)) else flat


def dog(g: np.ndarray, sigma: float) -> np.ndarray:
    """Absolute difference of Gaussians, summed over channels."""
    r = int(np.ceil(3 * 1.6 * sigma))
    p = kernels.padded(g, r, Border.REFLECT101)
    return np.abs(kernels.smooth(p, sigma, r) - kernels.smooth(p, 1.6 * sigma, r)).sum(2)


def cubic(g: np.ndarray, s: int, a: float = -0.75) -> np.ndarray:
    """Every s-th point (at block centres) by the Keys kernel over 4x4 neighbours."""
    p = kernels.padded(g, 2, Border.REFLECT101)

    def axis(x: np.ndarray, n: int) -> np.ndarray:
        at = (np.arange(n // s if n >= s else 1) + 0.5) * s - 0.5
        base = np.floor(at).astype(int)
        out = 0
        for i in range(-1, 3):
            t = np.abs(at - (base + i))
            wt = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))
            out = out + wt.reshape(-1, 1, 1) * x[np.clip(base + i + 2, 0, len(x) - 1)]
        return out

    rows = axis(p, g.shape[0])
    return np.swapaxes(axis(np.swapaxes(rows, 0, 1), g.shape[1]), 0, 1)


def find_centres(g: np.ndarray, spec: FilterSpec, salt: int = 0) -> np.ndarray:
    """Centres of an image's guide by the settings."""
    mu = centres(sample(g, spec, salt), spec, salt)
    if spec.local_mu:  # the means of all pixels, not of the sample alone
        flat = g.reshape(-1, g.shape[2])
        of = distances(flat, mu).argmin(1)
        n = np.bincount(of, minlength=len(mu))
        new = np.stack([np.bincount(of, flat[:, c], len(mu)) for c in range(flat.shape[1])], 1)
        mu = np.where((n > 0)[:, None], new / np.maximum(n, 1)[:, None], mu)
    return mu


def filtered(f: np.ndarray, g: np.ndarray, mu: np.ndarray, spec: FilterSpec, r: int) -> np.ndarray:
    """f filtered over a block padded by r; the result is r pixels smaller on each side."""
    s = spec.downsample

    def smooth(image: np.ndarray) -> np.ndarray:
        if s == 1:
            return kernels.smooth(image, spec.sigma_space, r, spec.smoother, spec.order)
        # smoothed at a lower resolution: means of s x s pixels, spread out again
        h, w = (-(-n // s) for n in image.shape[:2])
        full = np.pad(image, ((0, h * s - image.shape[0]), (0, w * s - image.shape[1]), (0, 0)), mode="edge")
        low = full.reshape(h, s, w, s, -1).mean((1, 3))
        lr = -(-r // s)
        out = kernels.smooth(kernels.padded(low, lr, Border.REFLECT101), spec.sigma_space / s, lr, spec.smoother, spec.order)
        return out.repeat(s, 0).repeat(s, 1)[r : image.shape[0] - r, r : image.shape[1] - r]

    inner = (slice(r, f.shape[0] - r), slice(r, f.shape[1] - r))
    own, n = f[inner], f.shape[2]
    d = distances(g.reshape(-1, g.shape[2]), mu).reshape(*g.shape[:2], len(mu))
    c = np.exp(-d / (2 * spec.sigma_range**2))

    def parts(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = smooth(np.concatenate([weight[:, :, None] * f, weight[:, :, None]], axis=2))
        return both[:, :, :n], both[:, :, n:]

    if spec.component >= 0 or spec.variant != Variant.NYSTROM:
        images = []
        for k in range(len(mu)) if spec.component < 0 else [min(spec.component, len(mu) - 1)]:
            top, low = parts(c[:, :, k])
            images.append(np.where(low > 1e-12, top / np.where(low > 1e-12, low, 1), own))
        if spec.component >= 0:
            return images[0]
        far = np.sqrt(d[inner])
        if spec.variant == Variant.SOFT:
            a = np.exp(-spec.soft_lambda * (far - far.min(2, keepdims=True)))
        else:  # between the two nearest centres, in proportion to their distances
            a = np.zeros_like(far)
            near = np.argsort(far, axis=2, kind="stable")[:, :, :2]
            if near.shape[2] == 1:
                a[:] = 1
            else:
                d1, d2 = (np.take_along_axis(far, near[:, :, i : i + 1], 2) for i in (0, 1))
                t = np.where(d1 + d2 > 0, d2 / np.where(d1 + d2 > 0, d1 + d2, 1), 1.0)
                np.put_along_axis(a, near[:, :, :1], t, 2)
                np.put_along_axis(a, near[:, :, 1:], 1 - t, 2)
        a /= a.sum(2, keepdims=True)
        return sum(a[:, :, k : k + 1] * images[k] for k in range(len(mu)))
    value, vector = np.linalg.eigh(np.exp(-distances(mu, mu) / (2 * spec.sigma_range**2)))
    on = value > _LEAST * value.max()
    phi = c @ vector[:, on]
    top = low = 0
    for j, v in enumerate(value[on]):
        a, b = parts(phi[:, :, j])
        p = phi[inner][:, :, j : j + 1]
        top, low = top + p * a / v, low + p * b / v
    ok = np.abs(low) > 1e-8
    return np.where(ok, top / np.where(ok, low, 1), own)
