"""Runs that compare approximations with the exact filter: time, quality, sweeps over settings."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict
from itertools import product
from json import dumps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions.metrics import psnr, statistics
from prismgrid.model import RESULTS, FilterSpec
from prismgrid.plans.methods import reference, run_method


class References:
    """Exact results, computed once for equal settings and kept until dropped."""

    def __init__(self, px: DataFrame, nlm: bool = False, shape=None):
        self.px, self.nlm, self.shape, self._kept = px, nlm, shape, {}

    def get(self, spec: FilterSpec) -> DataFrame:
        key = (spec.sigma_space, spec.sigma_range, spec.radius, spec.border, spec.patch_radius if self.nlm else 0)
        if key not in self._kept:
            self._kept[key] = reference(self.px, spec, self.nlm, self.shape).persist()
        return self._kept[key]

    def drop(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()


def measure(px: DataFrame, method: int, spec: FilterSpec, references: References, repeats: int = 3, warmup: int = 1, crop: int = 0, nlm: bool = False) -> list[tuple]:
    """Rows of RESULTS: an action timed `repeats` times after `warmup` runs; each run draws its centres anew."""
    run_id, rows = uuid.uuid4().hex, []
    exact = references.get(spec)
    text = dumps({k: str(v) for k, v in asdict(spec).items()}, sort_keys=True)
    for i in range(warmup + repeats):
        out = run_method(method, px, spec.but(seed=spec.seed + i), nlm, references.shape).persist()
        began = time.perf_counter()
        out.agg(F.sum(F.get("f", 0))).collect()
        ms = (time.perf_counter() - began) * 1000
        if i >= warmup:
            rows += [(run_id, r.img_id, method, text, i - warmup, ms, r.psnr_db) for r in psnr(exact, out, crop).collect()]
        out.unpersist()
    return rows


def sweep(px: DataFrame, methods: list[int], base: FilterSpec, grid: dict[str, list], repeats: int = 3, warmup: int = 1, crop: int = 0, nlm: bool = False, shape=None) -> DataFrame:
    """RESULTS of every method with every combination of the grid's settings. Results are small; the pixels stay where they are."""
    references, rows = References(px, nlm, shape), []
    for values in product(*grid.values()):
        spec = base.but(**dict(zip(grid, values, strict=True)))
        for method in methods:
            rows += measure(px, method, spec, references, repeats, warmup, crop, nlm)
    references.drop()
    return px.sparkSession.createDataFrame(rows, RESULTS)


def summary(results: DataFrame) -> DataFrame:
    """Medians and spread of quality and time by method and settings."""
    quality = statistics(results, "psnr_db", "method", "spec")
    speed = results.groupBy("method", "spec").agg(F.median("elapsed_ms").alias("median_ms"), F.min("elapsed_ms").alias("min_ms"))
    return quality.join(speed, ["method", "spec"])


def gain(results: DataFrame, baseline: dict[str, str], by: list[str]) -> DataFrame:
    """Median psnr_db less that of the baseline with the same settings in `by`.

    baseline: the settings that make a run a baseline, such as {"cluster": "kmeans_pp_fast"};
    by: the settings that must agree, such as ["k", "rate"].
    """
    parsed = results.withColumns({f"_{c}": F.get_json_object("spec", f"$.{c}") for c in {*by, *baseline}})
    medians = parsed.groupBy("method", "spec", *(f"_{c}" for c in sorted({*by, *baseline}))).agg(F.median("psnr_db").alias("median_db"))
    is_base = F.lit(True)
    for c, v in baseline.items():
        is_base = is_base & (F.col(f"_{c}") == v)
    each = Window.partitionBy(*(f"_{c}" for c in by))
    base = F.max(F.when(is_base, F.col("median_db"))).over(each)
    return medians.withColumn("gain_db", F.col("median_db") - base).select("method", "spec", "median_db", "gain_db")


def gain_sweep(px: DataFrame, base: FilterSpec, ks=(3, 5, 7, 9, 11), sigmas=range(10, 49, 2), rates=(0.25, 0.0625, 0.5, 0.125), repeats: int = 3, shape=None) -> DataFrame:
    """Weighted k-means against k-means++ over cluster counts, weight widths and sampling rates; the baseline of each rate is its own."""
    plain = sweep(px, [0], base.but(cluster="kmeans_pp_fast"), {"k": list(ks), "rate": list(rates)}, repeats, shape=shape)
    weighted = sweep(px, [0], base.but(cluster="gauss_inv_means_pp"), {"k": list(ks), "rate": list(rates), "sigma_cluster": [float(s) for s in sigmas]}, repeats, shape=shape)
    return gain(plain.unionByName(weighted), {"cluster": "kmeans_pp_fast"}, ["k", "rate"])


def k_sweep(px: DataFrame, base: FilterSpec, ks=range(2, 21, 2), samplers=("cubic", "importance_map"), clusters=("kmeans_pp_fast", "gauss_inv_means_pp"), repeats: int = 3, shape=None) -> DataFrame:
    """Quality and time over cluster counts, samplers and cluster methods."""
    return summary(sweep(px, [0], base, {"k": list(ks), "sampler": list(samplers), "cluster": list(clusters)}, repeats, shape=shape))


def report(results: DataFrame) -> list[str]:
    """Lines of k, median psnr_db and median milliseconds."""
    rows = summary(results).select(F.get_json_object("spec", "$.k").cast("int").alias("k"), "median", "median_ms").orderBy("k").collect()
    return [f"{r.k},{r.median:.4f},{r.median_ms:.3f}" for r in rows]
