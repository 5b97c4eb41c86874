"""Sampling of pixels before clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions import kernels, lowrank
from prismgrid.model import Border, scale_of
from prismgrid.operators.border import sized
from prismgrid.operators.channels import hashed_uniform
from prismgrid.operators.tiling import Block, with_tiles


def stride(px: DataFrame, rate: float) -> DataFrame:
    """Every s-th pixel of every s-th line."""
    s = scale_of(rate)
    return px.where((F.col("y") % s == 0) & (F.col("x") % s == 0))


def with_gradient(px: DataFrame, column: str = "g", border: int = Border.REFLECT101, shape=None) -> DataFrame:
    """px with `gradient`: the sum over channels of the absolute central differences.

    Neighbours come by window functions along lines and columns, edges by the border rule.
    """
    rows = sized(px, shape)

    def along(axis: str, other: str, size: str):
        line = Window.partitionBy("img_id", other).orderBy(axis)
        value = F.col(column)
        before, after = F.lag(value, 1).over(line), F.lead(value, 1).over(line)
        second, last_but = F.first(value).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if border == Border.REFLECT101:
            before, after = F.coalesce(before, after, value), F.coalesce(after, before, value)
        elif border in (Border.REPLICATE, Border.REFLECT):
            before, after = F.coalesce(before, value), F.coalesce(after, value)
        elif border == Border.WRAP:
            before, after = F.coalesce(before, last_but), F.coalesce(after, second)
        else:
            zero = F.transform(value, lambda v: F.lit(0.0))
            before, after = F.coalesce(before, zero), F.coalesce(after, zero)
        return F.aggregate(F.zip_with(after, before, lambda a, b: F.abs(a - b) / 2), F.lit(0.0), lambda s, v: s + v)

    rows = rows.withColumn("_gy", along("y", "x", "_h")).withColumn("_gx", along("x", "y", "_w"))
    return rows.withColumn("gradient", F.col("_gy") + F.col("_gx")).select(*px.columns, "gradient")


def gradient_max(px: DataFrame, rate: float, column: str = "g", border: int = Border.REFLECT101, shape=None, decimals: int | None = None) -> DataFrame:
    """The pixel with the largest gradient of each s x s block; ties go to the first.

    decimals: gradients that are equal when rounded to so many are ties, so that the last
    bits of the sums decide nothing.
    """
    s = scale_of(rate)
    rows = with_gradient(px, column, border, shape)
    if decimals is not None:
        rows = rows.withColumn("gradient", F.round("gradient", decimals))
    block = Window.partitionBy("img_id", F.floor(F.col("y") / s), F.floor(F.col("x") / s)).orderBy(F.desc("gradient"), "y", "x")
    return rows.withColumn("_n", F.row_number().over(block)).where("_n = 1").select(*px.columns)


def importance(px: DataFrame, rate: float, seed: int = 0, column: str = "g", border: int = Border.REFLECT101, shape=None) -> DataFrame:
    """Pixels kept with a chance in proportion to their gradient, about `rate` of all; the same for a seed under any partitioning."""
    rows = with_gradient(px, column, border, shape)
    mean = rows.groupBy("img_id").agg(F.avg("gradient").alias("_m"))
    rows = rows.join(mean, "img_id")
    draw = hashed_uniform(F.col("img_id"), F.col("y"), F.col("x"), F.lit(seed))
    chance = F.when(F.col("_m") > 0, F.col("gradient") * F.lit(float(rate)) / F.col("_m")).otherwise(F.lit(float(rate)))
    return rows.where(draw <= chance).select(*px.columns)


def dither(px: DataFrame, rate: float, by_dog: bool = False, sigma: float = 3.0, tile=None, divisions=None, shape=None) -> DataFrame:
    """Pixels chosen by error diffusion of the gradient (or of a difference of Gaussians), a tile at a time."""
    halo = int(np.ceil(3 * 1.6 * sigma)) if by_dog else 1
    rows = with_tiles(px, halo, tile, divisions, Border.REFLECT101, shape).select("img_id", "y", "x", "f", "g", "tj", "ti", "_h", "_w", "_th", "_tw")

    def run(key, table):
        b = Block(key, table, halo, Border.REFLECT101)
        if by_dog:
            full = b.image("g")
            edge = np.abs(kernels.smooth(full, sigma, halo) - kernels.smooth(full, 1.6 * sigma, halo)).sum(2)
        else:
            edge = kernels.gradient(b.image("g"))
        y, x = np.nonzero(kernels.diffuse(edge, rate))
        both = {c: b.image(c, 0)[y, x].tolist() for c in ("f", "g")}
        return pa.table({"img_id": pa.array([b.img] * len(y), pa.int32()), "y": pa.array((y + b.y0).astype(np.int32)), "x": pa.array((x + b.x0).astype(np.int32)), **{c: pa.array(v, pa.list_(pa.float64())) for c, v in both.items()}})

    return rows.groupBy("img_id", "tj", "ti").applyInArrow(run, "img_id int, y int, x int, f array<double>, g array<double>")


def cubic(px: DataFrame, rate: float, divisions=None, tile=None, shape=None) -> DataFrame:
    """The image at a step of s by the Keys kernel; the tile's sides should be multiples of s."""
    s = scale_of(rate)
    rows = with_tiles(px, 2, tile, divisions, Border.REFLECT101, shape).select("img_id", "y", "x", "f", "g", "tj", "ti", "_h", "_w", "_th", "_tw")

    def run(key, table):
        b = Block(key, table, 2, Border.REFLECT101)
        f, g = (lowrank.cubic(b.image(c, 0), s) for c in ("f", "g"))
        h, w = f.shape[:2]
        y, x = np.divmod(np.arange(h * w), w)
        return pa.table({"img_id": pa.array([b.img] * (h * w), pa.int32()), "y": pa.array((y + b.y0 // s).astype(np.int32)), "x": pa.array((x + b.x0 // s).astype(np.int32)), "f": pa.array(f.reshape(h * w, -1).tolist(), pa.list_(pa.float64())), "g": pa.array(g.reshape(h * w, -1).tolist(), pa.list_(pa.float64()))})

    return rows.groupBy("img_id", "tj", "ti").applyInArrow(run, "img_id int, y int, x int, f array<double>, g array<double>")


