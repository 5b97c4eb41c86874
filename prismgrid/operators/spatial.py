"""Spatial Gaussian smoothing of f: direct, or by a cosine series in constant time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prismgrid.functions import kernels
from prismgrid.model import Border, Smoother, radius_of
from prismgrid.operators.tiling import apply_tiles


def gaussian(px: DataFrame, *, sigma_space: float, radius: int | None = None, how: str = Smoother.FIR, order: int = 2, border: int = Border.REFLECT101, tile=None, divisions=None, shape=None) -> DataFrame:
    """px with f smoothed. FIR: 2r+1 taps an axis; SLIDING_COSINE: prefix sums, the cost does not follow the radius."""
    r = radius_of(sigma_space, radius)
    return apply_tiles(px, lambda b: kernels.smooth(b.image("f"), sigma_space, r, how, order), r, border, tile, divisions, shape)
