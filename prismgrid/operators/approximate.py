"""Approximate filters: clusters with Nystrom or blending, the permutohedral lattice, the KD-tree.

Each runs a tile at a time: one shuffle, then a kernel that sees the tile and its halo.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from prismgrid.functions import kernels, lattice, lowrank
from prismgrid.model import Border, FilterSpec
from prismgrid.operators.tiling import Block, apply_tiles


def _salt(b: Block) -> int:
    """Another draw for each tile, the same in every run."""
    return (b.img * 1_000_003 + b.tj) * 1_000_003 + b.ti & 0x7FFFFFFF


def _guide(b: Block, halo: int, patch: int | None, pca_dim: int | None) -> np.ndarray:
    """The tile's guide with its halo: patches if asked for, then the tile's own components."""
    g = b.image("g", halo + (patch or 0))
    if patch:
        g = kernels.im2col(g, patch)
    if pca_dim:
        _, basis, _ = kernels.principal(g.reshape(-1, g.shape[2]), pca_dim)
        g = g @ basis
    return g


def _extended(image: np.ndarray, more: int) -> np.ndarray:
    """The block with more pixels than its halo has, where the spatial window needs them."""
    return kernels.padded(image, more, Border.REFLECT101) if more > 0 else image


def cluster_filter(px: DataFrame, spec: FilterSpec, pca_dim: int | None = None, patch: int | None = None, shape=None) -> DataFrame:
    """px with f filtered by spec.variant over cluster centres of each tile.

    pca_dim: each tile's guide is reduced to its own components first; patch: the guide is
    the patches of this radius.
    """

    def kernel(b: Block) -> np.ndarray:
        halo = spec.halo
        g = _guide(b, halo, patch, pca_dim)
        inner = slice(halo, -halo or None)
        mu = lowrank.find_centres(g[inner, inner] if spec.crop_clustering else g, spec, _salt(b))
        r = max(spec.window, halo)
        f, g = (_extended(i, r - halo) for i in (b.image("f", halo), g))
        cut = r - spec.window
        inner = slice(cut, -cut or None)
        return lowrank.filtered(f[inner, inner], g[inner, inner], mu, spec, spec.window)

    return apply_tiles(px, kernel, spec.halo + (patch or 0), spec.border, None, spec.divisions, shape)


def _position_filter(px: DataFrame, spec: FilterSpec, smooth, pca_dim: int | None, patch: int | None, shape) -> DataFrame:
    def kernel(b: Block) -> np.ndarray:
        halo = spec.halo
        g, f = _guide(b, halo, patch, pca_dim), b.image("f", halo)
        out = smooth(lattice.positions(g, spec.sigma_space, spec.sigma_range), f.reshape(-1, f.shape[2])).reshape(f.shape)
        return out[halo : halo + b.h, halo : halo + b.w]

    return apply_tiles(px, kernel, spec.halo + (patch or 0), spec.border, None, spec.divisions, shape)


def lattice_filter(px: DataFrame, spec: FilterSpec, pca_dim: int | None = None, patch: int | None = None, shape=None) -> DataFrame:
    """px with f filtered over the permutohedral lattice of each tile."""
    return _position_filter(px, spec, lattice.permutohedral, pca_dim, patch, shape)


def kd_tree_filter(px: DataFrame, spec: FilterSpec, pca_dim: int | None = None, patch: int | None = None, shape=None) -> DataFrame:
    """px with f filtered over the Gaussian KD-tree of each tile."""
    return _position_filter(px, spec, lattice.kd_tree, pca_dim, patch, shape)


def tile_centres(px: DataFrame, spec: FilterSpec, shape=None) -> DataFrame:
    """The cluster centres of each tile: img_id, tj, ti, k, mu, weight (pixels nearest to it)."""
    import pyarrow as pa

    from prismgrid.functions.clustering import distances
    from prismgrid.operators.tiling import with_tiles

    rows = with_tiles(px, 0, None, spec.divisions, spec.border, shape).select("img_id", "y", "x", "f", "g", "tj", "ti", "_h", "_w", "_th", "_tw")

    def run(key, table):
        b = Block(key, table, 0, spec.border)
        g = b.image("g")
        mu = lowrank.find_centres(g, spec, _salt(b))
        n = np.bincount(distances(g.reshape(-1, g.shape[2]), mu).argmin(1), minlength=len(mu)).astype(float)
        k = len(mu)
        return pa.table({"img_id": pa.array([b.img] * k, pa.int32()), "tj": pa.array([b.tj] * k, pa.int32()), "ti": pa.array([b.ti] * k, pa.int32()), "k": pa.array(range(k), pa.int32()), "mu": pa.array(mu.tolist(), pa.list_(pa.float64())), "weight": n})

    return rows.groupBy("img_id", "tj", "ti").applyInArrow(run, "img_id int, tj int, ti int, k int, mu array<double>, weight double")


def kernel_eigenvalues(centers: DataFrame, sigma_range: float) -> DataFrame:
    """The eigenvalues of each tile's kernel between centres: img_id, tj, ti, j, value, largest first."""
    import pyarrow as pa

    from prismgrid.functions.clustering import distances

    def run(key, table):
        mu = np.array(table["mu"].to_pylist())
        value = np.sort(np.linalg.eigvalsh(np.exp(-distances(mu, mu) / (2 * sigma_range**2))))[::-1]
        n = len(value)
        ids = [pa.array([k.as_py()] * n, pa.int32()) for k in key]
        return pa.table({"img_id": ids[0], "tj": ids[1], "ti": ids[2], "j": pa.array(range(n), pa.int32()), "value": value})

    return centers.groupBy("img_id", "tj", "ti").applyInArrow(run, "img_id int, tj int, ti int, j int, value double")


def halo_of(truncate: float, sigma_space: float) -> int:
    """A halo of so many deviations."""
    return math.ceil(truncate * sigma_space)
