"""Quality and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def psnr(a: DataFrame, b: DataFrame, crop: int = 0, peak: float = 255.0) -> DataFrame:
    """img_id, mse, psnr_db of the f columns; crop: pixels left out at each edge. Equal images have an infinite psnr_db."""
    both = a.select("img_id", "y", "x", F.col("f").alias("_a")).join(b.select("img_id", "y", "x", F.col("f").alias("_b")), ["img_id", "y", "x"])
    if crop:
        dims = a.groupBy("img_id").agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
        both = both.join(dims, "img_id").where((F.col("y") >= crop) & (F.col("x") >= crop) & (F.col("y") <= F.col("_my") - crop) & (F.col("x") <= F.col("_mx") - crop))
    err = F.aggregate(F.zip_with("_a", "_b", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    mse = both.groupBy("img_id").agg((F.sum(err) / F.sum(F.size("_a"))).alias("mse"))
    return mse.select("img_id", "mse", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.col("mse"))).alias("psnr_db"))


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, median, mean, min, max and population standard deviation of a column."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
