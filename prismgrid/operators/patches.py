"""Patches as channels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prismgrid.functions import kernels
from prismgrid.model import Border
from prismgrid.operators.tiling import apply_tiles


def im2col(px: DataFrame, r: int, border: int = Border.REFLECT101, shape: tuple[int, int] | None = None, column: str = "g") -> DataFrame:
    """px with the guide replaced by each pixel's (2r+1)^2 patch of `column`.

    Channel ((dy+r)(2r+1) + dx+r)C + c holds channel c at offset (dy, dx). A tile gets r more
    pixels on each side, so that a pixel is sent about once; patches are made in the tile.
    """
    if border == Border.CONSTANT:
        raise ValueError("patches need a border other than constant")
    return apply_tiles(px, lambda b: kernels.im2col(b.image(column, r), r), r, border, shape=shape, into="g")
