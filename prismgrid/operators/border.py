"""Borders, padding and cropping as column expressions and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.model import Border


def remapped(i: Column, n: Column, border: int) -> Column:
    """Where an index outside [0, n) takes its value from; null for a constant border."""
    if border == Border.REPLICATE:
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if border == Border.WRAP:
        return F.pmod(i, n)
    if border == Border.REFLECT:
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    if border == Border.REFLECT101:
        m = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
        return F.when(n == 1, F.lit(0)).when(m < n, m).otherwise(2 * (n - 1) - m)
    return F.when((i >= 0) & (i < n), i)


def sized(px: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """px with its image's height and width as _h and _w. shape: the same for all images, which saves a pass."""
    if shape:
        return px.withColumns({"_h": F.lit(shape[0]), "_w": F.lit(shape[1])})
    dims = px.groupBy("img_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    return px.join(dims, "img_id")


def _copies(at: Column, n: Column, r: int, border: int) -> Column:
    """Places in [-r, n + r) that take their value from index `at`: candidates from the border's symmetry, then checked."""
    if border == Border.CONSTANT:
        return F.array(at)
    if border == Border.REPLICATE:
        before = F.when(at == 0, F.sequence(F.lit(-r), F.lit(0))).otherwise(F.array(at))
        return F.when((at == n - 1) & F.lit(r > 0), F.array_union(before, F.sequence(n - 1, n - 1 + r))).otherwise(before)
    period = n if border == Border.WRAP else 2 * n if border == Border.REFLECT else F.greatest(2 * (n - 1), F.lit(1))
    turns = F.sequence(-F.ceil((r + n) / period).cast("int"), F.ceil((r + n) / period).cast("int"))
    mirror = {Border.WRAP: at, Border.REFLECT: -1 - at, Border.REFLECT101: -at}[Border(border)]
    every = F.array_distinct(F.flatten(F.transform(turns, lambda t: F.array(at + t * period, mirror + t * period))))
    return F.filter(every, lambda i: (i >= -r) & (i < n + r))


def pad(px: DataFrame, r: int, border: int = Border.REFLECT101, value: float = 0.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """px with r more pixels on each side, at coordinates from 0.

    Each pixel is sent to the places that repeat it: no join and no shuffle. A constant
    border has `value` in every channel; its frame comes from the image's edge pixels.
    """
    px = sized(px, shape)
    out = px.withColumn("_ys", _copies(F.col("y"), F.col("_h"), r, border)).withColumn("_xs", _copies(F.col("x"), F.col("_w"), r, border))
    if border != Border.CONSTANT:
        out = out.withColumn("_y", F.explode("_ys")).withColumn("_x", F.explode("_xs"))
        return out.select("img_id", (F.col("_y") + r).cast("int").alias("y"), (F.col("_x") + r).cast("int").alias("x"), "f", "g")
    # edge pixels make the frame: rows above and below over the full width, columns beside
    far = lambda at, n: F.when(at == 0, F.sequence(F.lit(-r), F.lit(0))).otherwise(F.array(at))
    far_end = lambda s, at, n: F.when(at == n - 1, F.array_union(s, F.sequence(n - 1, n - 1 + r))).otherwise(s)
    ys, xs = (far_end(far(F.col(c), F.col(n)), F.col(c), F.col(n)) for c, n in (("y", "_h"), ("x", "_w")))
    out = px.withColumn("_ys", ys).withColumn("_xs", xs).withColumn("_y", F.explode("_ys")).withColumn("_x", F.explode("_xs"))
    own = (F.col("_y") == F.col("y")) & (F.col("_x") == F.col("x"))
    blank = lambda c: F.when(own, F.col(c)).otherwise(F.transform(c, lambda v: F.lit(float(value)))).alias(c)
    return out.select("img_id", (F.col("_y") + r).cast("int").alias("y"), (F.col("_x") + r).cast("int").alias("x"), blank("f"), blank("g"))


def crop(px: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """The rectangle's pixels, at coordinates from 0."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return px.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def check_dense(px: DataFrame) -> None:
    """Raises ValueError unless every image is a full rectangle from (0, 0) without repeated pixels."""
    about = px.groupBy("img_id").agg(F.count("*").alias("n"), F.count_distinct("y", "x").alias("u"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    bad = about.where("n <> u or y0 <> 0 or x0 <> 0 or n <> (y1 + 1) * (x1 + 1)").limit(1).collect()
    if bad:
        raise ValueError(f"image {bad[0].img_id} is not a full rectangle of single pixels")
