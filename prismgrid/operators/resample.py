"""Resampling and repair of rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.operators.border import sized


def _mean_channels(rows: DataFrame, weight: Column) -> DataFrame:
    """Weighted means of f and g over equal (img_id, y, x)."""
    long = rows.select("img_id", "y", "x", weight.alias("_wt"), F.posexplode(F.concat("f", "g")).alias("_c", "_v"), F.size("f").alias("_n"))
    sums = long.groupBy("img_id", "y", "x", "_c").agg((F.sum(F.col("_v") * F.col("_wt")) / F.sum("_wt")).alias("_v"), F.first("_n").alias("_n"))
    one = sums.groupBy("img_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_p"), F.first("_n").alias("_n"))
    return one.select("img_id", "y", "x", F.slice("_p._v", F.lit(1), F.col("_n")).alias("f"), F.slice(F.col("_p._v"), F.col("_n") + 1, F.size("_p") - F.col("_n")).alias("g"))


def resize_area(px: DataFrame, height: int, width: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """px scaled to height x width; each new pixel is the mean of what it covers, weighted by the overlap.

    Each pixel is sent to the few new pixels that it overlaps, so there is no range join.
    """
    rows = sized(px, shape)

    def overlaps(at: str, size: str, new: int) -> Column:
        scale = F.lit(float(new)) / F.col(size)
        low, high = F.col(at) * scale, (F.col(at) + 1) * scale
        cells = F.sequence(F.floor(low + 1e-9).cast("int"), F.greatest(F.floor(low + 1e-9), F.ceil(high - 1e-9) - 1).cast("int"))
        return F.filter(F.transform(cells, lambda c: F.struct(c.alias("at"), (F.least(high, c + F.lit(1.0)) - F.greatest(low, c + F.lit(0.0))).alias("wt"))), lambda s: (s["wt"] > 1e-9) & (s["at"] < new))

    rows = rows.withColumn("_y", F.explode(overlaps("y", "_h", height))).withColumn("_x", F.explode(overlaps("x", "_w", width)))
    rows = rows.select("img_id", F.col("_y.at").alias("y"), F.col("_x.at").alias("x"), (F.col("_y.wt") * F.col("_x.wt")).alias("_wt"), "f", "g")
    return _mean_channels(rows, F.col("_wt"))


def shrink(px: DataFrame, s: int) -> DataFrame:
    """Means of s x s blocks."""
    rows = px.withColumns({"y": F.floor(F.col("y") / s).cast("int"), "x": F.floor(F.col("x") / s).cast("int")})
    return _mean_channels(rows, F.lit(1.0))


def resize_nearest(px: DataFrame, height: int, width: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """New pixel i takes old pixel floor(i * old / new): each pixel is sent to the new ones that take it."""
    rows = sized(px, shape)

    def taken(at: str, size: str, new: int) -> Column:
        low = F.ceil(F.col(at).cast("long") * new / F.col(size)).cast("int")
        high = F.ceil((F.col(at).cast("long") + 1) * new / F.col(size)).cast("int")
        return F.filter(F.sequence(F.greatest(low - 1, F.lit(0)), F.least(high + 1, F.lit(new - 1))), lambda i: F.floor(i.cast("long") * F.col(size) / new) == F.col(at))

    rows = rows.withColumn("_y", F.explode(taken("y", "_h", height))).withColumn("_x", F.explode(taken("x", "_w", width)))
    return rows.select("img_id", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "f", "g")


def fill_occlusion(px: DataFrame, missing: Column) -> DataFrame:
    """px with missing values of f's first channel filled from the nearest ones left and right, the smaller of the two.

    The smaller disparity is the background's. A line without any value keeps what it has.
    """
    v = F.when(~missing, F.get("f", 0))
    line = Window.partitionBy("img_id", "y").orderBy("x")
    left = F.last(v, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(v, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    filled = F.when(missing, F.coalesce(F.least(left, right), F.get("f", 0))).otherwise(F.get("f", 0))
    return px.withColumn("_v", filled).withColumn("f", F.concat(F.array("_v"), F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))))).drop("_v")


def mosaic(px: DataFrame, columns: int, height: int, width: int) -> DataFrame:
    """Images of one size side by side as one image, `columns` in a row, in order of img_id."""
    order = px.select("img_id").distinct().withColumn("_n", F.row_number().over(Window.orderBy("img_id")) - 1)
    rows = px.join(order, "img_id")
    return rows.select(F.lit(0).alias("img_id"), (F.col("y") + F.floor(F.col("_n") / columns) * height).cast("int").alias("y"), (F.col("x") + F.col("_n") % columns * width).cast("int").alias("x"), "f", "g")
