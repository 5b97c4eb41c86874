"""Filter an image from the command line: python -m prismgrid.plans.cli SOURCE --out OUT."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prismgrid.functions.metrics import psnr
from prismgrid.model import Border, Cluster, FilterSpec, Sampler, Smoother, Variant
from prismgrid.plans.methods import reference, run_cell
from prismgrid.shipping import ship
from prismgrid.sources.images import read_images, save_png


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prismgrid", description="High-dimensional Gaussian filtering of images.")
    p.add_argument("source", help="image file to filter")
    p.add_argument("--guide", help="guide image (default: the source)")
    p.add_argument("--out", help="folder for the result")
    p.add_argument("--sigma-space", type=float, default=3.0)
    p.add_argument("--sigma-range", type=float, default=30.0)
    p.add_argument("--radius", type=int, default=0, help="0: three deviations")
    p.add_argument("--filter", type=int, choices=range(4), default=1, help="0 exact, 1 clusters, 2 lattice, 3 KD-tree")
    p.add_argument("--reduction", type=int, choices=range(3), default=0, help="0 none, 1 PCA of the image, 2 PCA of each tile")
    p.add_argument("--pca-dim", type=int, default=3)
    p.add_argument("--patch", type=int, default=0, help="patch radius of non-local means; 0: off")
    p.add_argument("--clusters", type=int, default=10)
    p.add_argument("--cluster-method", choices=[str(c) for c in Cluster], default=str(Cluster.GAUSS_INV_MEANS_PP))
    p.add_argument("--variant", choices=[str(v) for v in Variant][:3], default=str(Variant.NYSTROM))
    p.add_argument("--sampler", choices=[str(s) for s in Sampler], default=str(Sampler.DITHER_GRADIENT_MAX))
    p.add_argument("--smoother", choices=[str(s) for s in Smoother], default=str(Smoother.SLIDING_COSINE))
    p.add_argument("--rate", type=float, default=0.25)
    p.add_argument("--lloyd", type=int, default=10, help="iterations of k-means")
    p.add_argument("--divisions", type=int, nargs=2, default=(8, 8), help="tiles along each axis")
    p.add_argument("--border", type=int, choices=range(5), default=int(Border.REFLECT101))
    p.add_argument("--iterations", type=int, default=1, help="timed runs")
    p.add_argument("--check", action="store_true", help="compare with the exact filter")
    p.add_argument("--debug", action="store_true", help="print the plan")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[tuple[float, float]]:
    """Runs the filter; returns (psnr_db or nan, milliseconds) of each run."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    spec = FilterSpec(
        sigma_space=a.sigma_space, sigma_range=a.sigma_range, radius=a.radius or None, border=Border(a.border), divisions=tuple(a.divisions), variant=Variant(a.variant), cluster=Cluster(a.cluster_method),
        k=a.clusters, iterations=a.lloyd, rate=a.rate, sampler=Sampler(a.sampler), smoother=Smoother(a.smoother), pca_dim=a.pca_dim, patch_radius=a.patch or 1,
    )
    src = read_images(spark, a.source, F.lit(0))
    guide = read_images(spark, a.guide, F.lit(0)) if a.guide else src
    px = src.join(guide.select("img_id", "y", "x", F.col("f").alias("g")), ["img_id", "y", "x"]).persist() if a.guide else src.withColumn("g", F.col("f")).persist()
    exact = reference(px, spec, bool(a.patch)).persist() if a.check else None
    runs, out = [], None
    for i in range(a.iterations):
        out = run_cell(a.filter, a.reduction, a.patch, px, spec.but(seed=i)).persist()
        began = time.perf_counter()
        out.agg(F.sum(F.get("f", 0))).collect()
        ms = (time.perf_counter() - began) * 1000
        runs.append((psnr(exact, out).first().psnr_db if exact is not None else float("nan"), ms))
        print("{:9.2f}, {:8.2f}".format(*runs[-1]))
    if a.debug:
        out.explain("formatted")
    if a.out:
        save_png(out, a.out, "result_{}.png")
    return runs


if __name__ == "__main__":
    main()
