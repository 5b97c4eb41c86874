"""The exact high-dimensional Gaussian filter: bilateral, joint bilateral and, over patches, non-local means.

out(p) = sum w(p,q) f(q) / sum w(p,q) over the square window of radius r around p, with
w = exp(-|p-q|^2 / 2 sigma_space^2 - |g(p)-g(q)|^2 / 2 sigma_range^2). Pixels outside the
image are those that the border rule names, at their unmapped distance; with a constant
border they do not count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.functions import kernels
from prismgrid.model import Border, radius_of
from prismgrid.operators.border import _copies, sized
from prismgrid.operators.tiling import apply_tiles


def hdgf(px: DataFrame, *, sigma_space: float, sigma_range: float, radius: int | None = None, border: int = Border.REFLECT101, plan: str = "tile", tile: tuple[int, int] | None = None, divisions: tuple[int, int] | None = None, shape: tuple[int, int] | None = None, patch: int = 0, column: str = "g") -> DataFrame:
    """px with f filtered. plan "tile": a kernel for each tile, one shuffle; "join": SQL only, a row for each tap, for small radii.

    patch: the guide is the patches of this radius of `column`, made in the tile (non-local means).
    """
    r = radius_of(sigma_space, radius)
    if plan == "join":
        if patch or column != "g":
            raise ValueError("the join has the guide as it is: use im2col first")
        return _by_join(px, r, sigma_space, sigma_range, border, shape)

    def kernel(b):
        g = b.patches(column, r, patch) if patch else b.image(column, r)
        return kernels.hdgf(b.image("f", r), g, r, sigma_space, sigma_range, b.inside(r))

    return apply_tiles(px, kernel, r + patch, border, tile, divisions, shape)


def _by_join(px: DataFrame, r: int, sigma_space: float, sigma_range: float, border: int, shape) -> DataFrame:
    rows = sized(px, shape).withColumn("_y", F.explode(_copies(F.col("y"), F.col("_h"), r, border))).withColumn("_x", F.explode(_copies(F.col("x"), F.col("_w"), r, border)))
    step = F.sequence(F.lit(-r), F.lit(r))
    taps = rows.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    taps = taps.select("img_id", (F.col("_y") - F.col("_dy")).cast("int").alias("y"), (F.col("_x") - F.col("_dx")).cast("int").alias("x"), F.col("f").alias("_f"), F.col("g").alias("_g"), (F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx")).cast("double").alias("_s"), "_h", "_w")
    taps = taps.where("y >= 0 and y < _h and x >= 0 and x < _w").drop("_h", "_w")
    both = taps.join(px.select("img_id", "y", "x", "g"), ["img_id", "y", "x"])
    apart = F.aggregate(F.zip_with("g", "_g", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    both = both.withColumn("_wt", F.exp(-F.col("_s") / F.lit(2.0 * sigma_space**2) - apart / F.lit(2.0 * sigma_range**2)))
    long = both.select("img_id", "y", "x", "g", "_wt", F.posexplode("_f").alias("_c", "_v"))
    sums = long.groupBy("img_id", "y", "x", "_c").agg((F.sum(F.col("_wt") * F.col("_v")) / F.sum("_wt")).alias("_o"), F.first("g").alias("g"))
    out = sums.groupBy("img_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct("_c", "_o"))).alias("_p"), F.first("g").alias("g"))
    return out.select("img_id", "y", "x", F.col("_p._o").alias("f"), "g")


def hdgf_tile_pca(px: DataFrame, *, sigma_space: float, sigma_range: float, pca_dim: int, radius: int | None = None, border: int = Border.REFLECT101, tile: tuple[int, int] | None = None, divisions: tuple[int, int] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """The exact filter with each tile's guide reduced to its own pca_dim principal components.

    The halo is the radius rounded up to a multiple of 8, and the tile's basis sees it.
    """
    r = radius_of(sigma_space, radius)
    halo = math.ceil(r / 8) * 8

    def kernel(b):
        g = b.image("g")
        _, basis, _ = kernels.principal(g.reshape(-1, g.shape[2]), pca_dim)
        cut = halo - r
        inner = slice(cut, -cut or None)
        inside = b.inside(r)
        return kernels.hdgf(b.image("f", r), (g @ basis)[inner, inner], r, sigma_space, sigma_range, inside)

    return apply_tiles(px, kernel, halo, border, tile, divisions, shape)


def range_smooth(vectors: DataFrame, *, sigma_range: float, block: int = 2048) -> DataFrame:
    """The filter without an image: each vector becomes the mean of all, weighted by the Gaussian of their distance.

    vectors: id, g. A hash of the id deals vectors to blocks of about `block`; blocks meet in
    pairs, each pair in a task of its own, and a task gives a partial sum a vector. Returns id, f.
    """
    import numpy as np
    import pyarrow as pa

    blocks = max(1, -(-vectors.count() // block))

    def pack(key, table):
        g = table["g"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        ids = table["id"].to_numpy().astype(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "g": pa.array([g.tobytes()], pa.binary())})

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                a = np.frombuffer(r["g"], float).reshape(len(ids), -1)
                b = np.frombuffer(r["other_g"], float).reshape(-1, a.shape[1])
                d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
                w = np.exp(-np.maximum(d, 0) / (2 * sigma_range**2))
                flat = (w @ b).ravel()
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * a.shape[1], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids), sums, pa.array(w.sum(1))], ["id", "s", "w"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), "g").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = rows.groupBy("block").applyInArrow(pack, "block int, ids binary, g binary")
    others = packed.select(F.col("block").alias("other"), F.col("g").alias("other_g"))
    todo = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("block", "other").join(others, "other").select("ids", "g", "other_g")
    part = todo.mapInArrow(meet, "id long, s array<double>, w double")
    long = part.select("id", "w", F.posexplode("s").alias("c", "v"))
    out = long.groupBy("id", "c").agg((F.sum("v") / F.sum("w")).alias("v"))
    return out.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("p")).select("id", F.col("p.v").alias("f"))
