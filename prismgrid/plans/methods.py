"""Ready-made compositions: ten methods by number, and the command line's grid of filter, reduction and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prismgrid.model import FilterSpec
from prismgrid.operators import pca
from prismgrid.operators.approximate import cluster_filter, kd_tree_filter, lattice_filter
from prismgrid.operators.exact import hdgf
from prismgrid.operators.patches import im2col

# The methods' names.
METHODS = {
    -1: "copy",
    0: "clusters, full guide",
    1: "clusters, PCA of the image",
    2: "clusters, PCA of each tile",
    3: "permutohedral lattice",
    4: "permutohedral lattice, PCA of the image",
    5: "permutohedral lattice, PCA of each tile",
    6: "Gaussian KD-tree",
    7: "Gaussian KD-tree, PCA of the image",
    8: "Gaussian KD-tree, PCA of each tile",
}
_FILTERS = (cluster_filter, lattice_filter, kd_tree_filter)


def _patches(px: DataFrame, spec: FilterSpec, shape) -> DataFrame:
    return im2col(px, spec.patch_radius, spec.border, shape)


def run_method(code: int, px: DataFrame, spec: FilterSpec, nlm: bool = False, shape=None) -> DataFrame:
    """px with f filtered by a method; nlm: over patches of the guide, as in non-local means.

    Reduction to spec.pca_dim components is by image (1, 4, 7) or by tile (2, 5, 8).
    """
    if code not in METHODS:
        raise ValueError(f"no method {code}")
    if code == -1:
        return px
    run, reduction = _FILTERS[code // 3], code % 3
    if reduction == 2:
        return run(px, spec, pca_dim=spec.pca_dim, patch=spec.patch_radius if nlm else None, shape=shape)
    if nlm:
        px = _patches(px, spec, shape)
    if reduction == 1:
        px = pca.project(px, spec.pca_dim)
    return run(px, spec, shape=shape)


def run_cell(filter_kind: int, reduction: int, patch_radius: int, px: DataFrame, spec: FilterSpec, shape=None) -> DataFrame:
    """filter_kind: 0 exact, 1 clusters, 2 lattice, 3 KD-tree; reduction: 0 none, 1 by image, 2 by tile (not of the exact filter)."""
    if filter_kind not in range(4) or reduction not in range(3):
        raise ValueError(f"no filter {filter_kind} with reduction {reduction}")
    if patch_radius:
        spec = spec.but(patch_radius=patch_radius)
    if filter_kind == 0:
        return hdgf(px, sigma_space=spec.sigma_space, sigma_range=spec.sigma_range, radius=spec.radius, border=spec.border, divisions=spec.divisions, shape=shape, patch=patch_radius)
    return run_method(3 * (filter_kind - 1) + reduction, px, spec, bool(patch_radius), shape)


def reference(px: DataFrame, spec: FilterSpec, nlm: bool = False, shape=None) -> DataFrame:
    """The exact filter with the settings' sigmas."""
    return run_cell(0, 0, spec.patch_radius if nlm else 0, px, spec, shape)
