"""Numpy kernels over one block of pixels. Images are (height, width, channels) arrays of doubles."""

from __future__ import annotations

import numpy as np

from prismgrid.model import Border, Smoother


def remap(i: np.ndarray, n: int, border: int) -> np.ndarray:
    """Where an index outside [0, n) takes its value from; -1 for a constant border."""
    i = np.asarray(i)
    if border == Border.REPLICATE:
        return np.clip(i, 0, n - 1)
    if border == Border.WRAP:
        return i % n
    if border == Border.REFLECT:
        m = i % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)
    if border == Border.REFLECT101:
        if n == 1:
            return np.zeros_like(i)
        m = i % (2 * (n - 1))
        return np.where(m < n, m, 2 * (n - 1) - m)
    return np.where((i >= 0) & (i < n), i, -1)


def padded(image: np.ndarray, r: int, border: int, value: float = 0.0) -> np.ndarray:
    """The image with r more pixels on each side."""
    ys, xs = (remap(np.arange(-r, n + r), n, border) for n in image.shape[:2])
    out = image[ys][:, xs]
    if border == Border.CONSTANT:
        out[ys < 0] = value
        out[:, xs < 0] = value
    return out


def gaussian_taps(sigma: float, r: int) -> np.ndarray:
    """Gaussian weights at -r..r that sum to one."""
    n = np.arange(-r, r + 1)
    w = np.exp(-(n * n) / (2.0 * sigma * sigma))
    return w / w.sum()


def cosine_series(sigma: float, r: int, order: int) -> tuple[np.ndarray, float]:
    """(coefficients a_0..a_order, base angle) of the cosine series of the Gaussian over 2r+1 taps."""
    n = np.arange(-r, r + 1)
    g, t = gaussian_taps(sigma, r), 2 * r + 1
    angle = 2 * np.pi / t
    a = [g.sum() / t] + [2.0 / t * (g * np.cos(angle * k * n)).sum() for k in range(1, order + 1)]
    return np.array(a), angle


def _slide(x: np.ndarray, r: int) -> np.ndarray:
    """Sums of 2r+1 neighbours along the first axis, from prefix sums: constant time in r."""
    c = np.cumsum(np.concatenate([np.zeros_like(x[:1]), x]), axis=0)
    return c[2 * r + 1 :] - c[: -(2 * r + 1)]


def _smooth_first(x: np.ndarray, sigma: float, r: int, how: str, order: int) -> np.ndarray:
    if how == Smoother.FIR:
        w = gaussian_taps(sigma, r)
        return sum(w[i] * x[i : len(x) - 2 * r + i] for i in range(2 * r + 1))
    a, angle = cosine_series(sigma, r, order)
    out = a[0] * _slide(x, r)
    at = np.arange(len(x)).reshape(-1, *[1] * (x.ndim - 1))
    for k in range(1, len(a)):
        c, s = np.cos(angle * k * at), np.sin(angle * k * at)
        inner = c[r : len(x) - r] * _slide(x * c, r) + s[r : len(x) - r] * _slide(x * s, r)
        out = out + a[k] * inner
    return out


def smooth(image: np.ndarray, sigma: float, r: int, how: str = Smoother.FIR, order: int = 2) -> np.ndarray:
    """Gaussian smoothing of a padded image; the result is r pixels smaller on each side."""
    y = _smooth_first(image, sigma, r, how, order)
    return np.swapaxes(_smooth_first(np.swapaxes(y, 0, 1), sigma, r, how, order), 0, 1)


def hdgf(f: np.ndarray, g: np.ndarray, r: int, sigma_space: float, sigma_range: float, inside: np.ndarray | None = None) -> np.ndarray:
    """The exact filter over padded f and g; the result is r pixels smaller on each side.

    Each pixel becomes the mean of its (2r+1)^2 neighbours, weighted by Gaussians of the
    distance in the image and of the distance between guides. inside: pixels that count.
    """
    h, w = f.shape[0] - 2 * r, f.shape[1] - 2 * r
    centre = g[r : r + h, r : r + w]
    total, norm = np.zeros((h, w, f.shape[2])), np.zeros((h, w))
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            d = g[dy : dy + h, dx : dx + w] - centre
            wt = np.exp(-np.einsum("yxc,yxc->yx", d, d) / (2.0 * sigma_range * sigma_range) - ((dy - r) ** 2 + (dx - r) ** 2) / (2.0 * sigma_space * sigma_space))
            if inside is not None:
                wt = wt * inside[dy : dy + h, dx : dx + w]
            total += wt[:, :, None] * f[dy : dy + h, dx : dx + w]
            norm += wt
    return total / norm[:, :, None]


def im2col(image: np.ndarray, r: int) -> np.ndarray:
    """Patches of a padded image as channels: position (dy, dx) first, then the channel."""
    h, w = image.shape[0] - 2 * r, image.shape[1] - 2 * r
    return np.concatenate([image[dy : dy + h, dx : dx + w] for dy in range(2 * r + 1) for dx in range(2 * r + 1)], axis=2)


def principal(x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, basis with a column a component, eigenvalues) of rows x, strongest first."""
    return basis_of(len(x), x.sum(0), x.T @ x, dims)


def basis_of(n: float, total: np.ndarray, gram: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """principal() from the number of rows, their sum and the sum of their outer products.

    Signs are fixed: each component's largest loading is positive.
    """
    mean = total / max(n, 1)
    cov = gram / max(n, 1) - np.outer(mean, mean)
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-value, kind="stable")[: min(dims, len(value))]
    vector = vector[:, order]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return mean, vector * np.where(sign == 0, 1, sign), value[order]


def gradient(image: np.ndarray) -> np.ndarray:
    """Sum over channels of the absolute central differences, of an image padded by one."""
    dy = np.abs(image[2:, 1:-1] - image[:-2, 1:-1]) / 2
    dx = np.abs(image[1:-1, 2:] - image[1:-1, :-2]) / 2
    return (dy + dx).sum(2)


def diffuse(importance: np.ndarray, rate: float) -> np.ndarray:
    """A mask of about `rate` of the pixels, denser where importance is higher, by Floyd-Steinberg error diffusion."""
    mean = importance.mean()
    want = np.full(importance.shape, rate) if mean <= 0 else importance * (rate / mean)
    want = np.minimum(want, 1.0)
    h, w = want.shape
    err = np.zeros((h + 1, w + 2))
    mask = np.zeros((h, w), bool)
    for y in range(h):
        row = err[y]
        for x in range(w):
            v = want[y, x] + row[x + 1]
            on = v >= 0.5
            mask[y, x] = on
            e = v - on
            row[x + 2] += e * 7 / 16
            err[y + 1, x] += e * 3 / 16
            err[y + 1, x + 1] += e * 5 / 16
            err[y + 1, x + 2] += e / 16
    return mask
