"""Per-pixel operations on channel arrays: column expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.model import Signal


def split(px: DataFrame, column: str = "f") -> DataFrame:
    """A row for each channel: img_id, y, x, c, v."""
    return px.select("img_id", "y", "x", F.posexplode(column).alias("c", "v"))


def merge(planes: DataFrame, column: str = "f") -> DataFrame:
    """The inverse of split(): channels gathered in order."""
    rows = planes.groupBy("img_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("_p"))
    return rows.select("img_id", "y", "x", F.col("_p.v").alias(column))


def to_u8(v: Column) -> Column:
    """A value rounded half to even and kept within 0..255."""
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")


def concat_scaled(a: Column, b: Column, scale: float = 1.0, u8: bool = False) -> Column:
    """Channels of a, then those of b times scale; u8: all as 8-bit values, converted after the product."""
    both = F.concat(a, F.transform(b, lambda v: v * F.lit(float(scale))))
    return F.transform(both, lambda v: to_u8(v).cast("double")) if u8 else both


def as_u8(px: DataFrame, *columns: str) -> DataFrame:
    """The columns' channels as 8-bit values (still doubles, in range)."""
    return px.withColumns({c: F.transform(c, lambda v: to_u8(v).cast("double")) for c in columns or ("f",)})


def as_float(px: DataFrame, *columns: str) -> DataFrame:
    """The columns' channels rounded to 32-bit floats."""
    return px.withColumns({c: F.transform(c, lambda v: v.cast("float").cast("double")) for c in columns or ("f",)})


def amplified_difference(a: Column, b: Column, boost: int = 0) -> Column:
    """(a - b) * 2^boost by channel."""
    return F.zip_with(a, b, lambda u, v: (u - v) * F.lit(float(2**boost)))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b by channel."""
    return F.zip_with(a, b, lambda u, v: F.lit(float(alpha)) * u + F.lit(1.0 - alpha) * v)


def average_gray(f: Column) -> Column:
    """The mean of the channels."""
    return F.aggregate(f, F.lit(0.0), lambda s, v: s + v) / F.size(f)


def replicate(v: Column, n: int = 3) -> Column:
    """One value in n channels."""
    return F.array_repeat(v, n)


def linear_map(f: Column, matrix: list[list[float]]) -> Column:
    """A fixed linear map of the channels, such as bands to a preview: a row of the matrix for each output."""
    return F.array(*(sum((F.get(f, i) * F.lit(float(w)) for i, w in enumerate(row)), F.lit(0.0)) for row in matrix))


def hashed_uniform(*parts: Column) -> Column:
    """A number above 0 and up to 1 from the parts' text by MD5: 52 bits, the same on every engine and under any partitioning."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double")
    return (bits + 1) / F.lit(float((1 << 52) + 1))


def add_noise(px: DataFrame, sigma: float, seed: int = 0, column: str = "f") -> DataFrame:
    """Gaussian noise by channel, the same for a seed under any partitioning."""

    def uniform(salt: int, i: Column) -> Column:
        return hashed_uniform(F.col("img_id"), F.col("y"), F.col("x"), i, F.lit(seed * 2 + salt))

    noise = lambda v, i: v + F.lit(float(sigma)) * F.sqrt(-2 * F.log(uniform(0, i))) * F.cos(F.lit(6.283185307179586) * uniform(1, i))
    return px.withColumn(column, F.transform(column, noise))


def floor_to(n: Column | int, m: int):
    """n rounded down to a multiple of m."""
    return n // m * m if isinstance(n, int) else F.floor(n / m) * m


def ceil_to(n: Column | int, m: int):
    """n rounded up to a multiple of m."""
    return -(-n // m) * m if isinstance(n, int) else F.ceil(n / m) * m


def guided(a: DataFrame, b: DataFrame | None, kind: Signal, scale: float = 1.0, patch: int = 1) -> DataFrame:
    """A raster of this kind of signal from its parts (tables with img_id, y, x, f).

    RGB, HSI: a alone. RGBIR: a, guide a and scaled b. RGBD: a is rgb and b disparity; b is
    filtered. FNF: a is the no-flash image, b the flash image. NLM: a, guide its patches.
    """
    from prismgrid.operators.patches import im2col

    if kind in (Signal.RGB, Signal.HSI):
        return a.select("img_id", "y", "x", "f", F.col("f").alias("g"))
    if kind == Signal.NLM:
        return im2col(a.select("img_id", "y", "x", "f", F.col("f").alias("g")), patch)
    both = a.select("img_id", "y", "x", "f").join(b.select("img_id", "y", "x", F.col("f").alias("_b")), ["img_id", "y", "x"])
    signal = F.col("_b") if kind == Signal.RGBD else F.col("f")
    guide = concat_scaled(F.col("_b"), F.col("f"), scale) if kind == Signal.FNF else concat_scaled(F.col("f"), F.col("_b"), scale)
    return both.select("img_id", "y", "x", signal.alias("f"), guide.alias("g"))
