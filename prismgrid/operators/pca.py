"""Principal components of the guide: of whole images, of tiles, of patches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.functions import kernels
from prismgrid.model import Border
from prismgrid.operators.patches import im2col
from prismgrid.operators.tiling import apply_tiles

_BASIS = "img_id int, mean array<double>, basis array<array<double>>, eigenvalues array<double>"


def moments(px: DataFrame, column: str = "g") -> DataFrame:
    """img_id, n, total, gram (flat): sums over each image, from one partial row a batch and image."""

    def partial(batches):
        for batch in batches:
            img = batch.column("img_id").to_numpy()
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            rows = [(int(i), (own := x[img == i])) for i in np.unique(img)]
            yield pa.RecordBatch.from_pydict({"img_id": pa.array([i for i, _ in rows], pa.int32()), "n": pa.array([float(len(o)) for _, o in rows]), "total": pa.array([o.sum(0) for _, o in rows], pa.list_(pa.float64())), "gram": pa.array([(o.T @ o).ravel() for _, o in rows], pa.list_(pa.float64()))})

    schema = "img_id int, n double, total array<double>, gram array<double>"
    part = px.select("img_id", column).mapInArrow(partial, schema)
    # n, then the totals, then the matrix, summed place by place: one pass, a few hundred rows a batch at most
    long = part.select("img_id", F.posexplode(F.concat(F.array("n"), "total", "gram")).alias("i", "v"))
    sums = long.groupBy("img_id", "i").agg(F.sum("v").alias("v"))
    one = sums.groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p")).select("img_id", F.col("p.v").alias("v"))
    dims = F.floor((F.sqrt(4 * F.size("v") - 3) - 1) / 2).cast("int")  # 1 + c + c^2 values
    return one.withColumn("c", dims).select("img_id", F.get("v", 0).alias("n"), F.slice("v", 2, F.col("c")).alias("total"), F.slice("v", 2 + F.col("c"), F.col("c") * F.col("c")).alias("gram"))


def fit(px: DataFrame, dims: int, column: str = "g") -> DataFrame:
    """img_id, mean, basis (one array a component), eigenvalues: a row for each image. dims beyond the channels are cut."""

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = len(r["total"])
                mean, basis, value = kernels.basis_of(r["n"], np.array(r["total"]), np.array(r["gram"]).reshape(c, c), dims)
                out.append({"img_id": r["img_id"], "mean": mean.tolist(), "basis": basis.T.tolist(), "eigenvalues": value.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("img_id", pa.int32()), ("mean", pa.list_(pa.float64())), ("basis", pa.list_(pa.list_(pa.float64()))), ("eigenvalues", pa.list_(pa.float64()))]))

    return moments(px, column).mapInArrow(solve, _BASIS)


def project(px: DataFrame, dims: int, column: str = "g") -> DataFrame:
    """px with the column replaced by its first components, without centring (distances are the same)."""
    both = px.join(fit(px, dims, column).select("img_id", "basis"), "img_id")
    dot = lambda v: F.aggregate(F.zip_with(F.col(column), v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.withColumn(column, F.transform("basis", dot)).select(*px.columns)


def reconstruct(px: DataFrame, dims: int, column: str = "g") -> DataFrame:
    """px with the column projected to its first components and back: mean + V V'(g - mean)."""
    both = px.join(fit(px, dims, column), "img_id")
    off = F.zip_with(F.col(column), F.col("mean"), lambda a, m: a - m)
    dot = lambda v: F.aggregate(F.zip_with(off, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    both = both.withColumn("_z", F.arrays_zip(F.transform("basis", dot).alias("z"), F.col("basis").alias("v")))
    back = F.aggregate("_z", F.col("mean"), lambda acc, p: F.zip_with(acc, p["v"], lambda m, v: m + p["z"] * v))
    return both.withColumn(column, back).select(*px.columns)


def project_tiles(px: DataFrame, dims: int, halo: int = 0, border: int = Border.REFLECT101, tile=None, divisions=None, shape=None) -> DataFrame:
    """px with f replaced by the guide's components in each tile's own basis, which sees the halo."""

    def kernel(b):
        g = b.image("g")
        _, basis, _ = kernels.principal(g.reshape(-1, g.shape[2]), dims)
        return b.image("g", 0) @ basis

    return apply_tiles(px, kernel, halo, border, tile, divisions, shape)


def patch_pca(px: DataFrame, r: int, dims: int, border: int = Border.REFLECT101, shape=None) -> DataFrame:
    """px with the guide replaced by the first components of its patches over whole images."""
    return project(im2col(px, r, border, shape), dims)


def patch_pca_tiles(px: DataFrame, r: int, dims: int, halo: int = 0, border: int = Border.REFLECT101, tile=None, divisions=None, shape=None) -> DataFrame:
    """px with f replaced by the first components of the guide's patches, in each tile's own basis."""

    def kernel(b):
        p = kernels.im2col(b.image("g"), r)
        _, basis, _ = kernels.principal(p.reshape(-1, p.shape[2]), dims)
        return p[halo : halo + b.h, halo : halo + b.w] @ basis

    return apply_tiles(px, kernel, halo + r, border, tile, divisions, shape)


def reconstruction_psnr(px: DataFrame, dims: int, column: str = "g") -> DataFrame:
    """img_id, psnr_db of the column against its reconstruction from `dims` components."""
    from prismgrid.functions.metrics import psnr

    return psnr(px.select("img_id", "y", "x", F.col(column).alias("f")), reconstruct(px, dims, column).select("img_id", "y", "x", F.col(column).alias("f")))
