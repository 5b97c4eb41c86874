"""Sets of test images: reading them as pairs or stacks, and preparing them from raw files.

All paths are parameters; {} stands for the number or name of a scene. A set is a lazy
DataFrame, so one that is not used is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.model import Border
from prismgrid.operators.border import crop, pad, sized
from prismgrid.operators.channels import floor_to
from prismgrid.operators.resample import fill_occlusion, resize_area, resize_nearest
from prismgrid.sources.images import paired, read_images, stacked

# Numbers of the colour images, names of the depth scenes.
COLOUR = (1, 2, 3, 4, 5, 6, 7, 8, 9, 13)
DEPTH = ("Aloe", "Baby1", "Books", "Bowling1", "Cloth1", "ConesH", "Dolls", "Laundry", "Reindeer", "TeddyH")


def _each(spark: SparkSession, pattern: str, names, gray: bool = False) -> DataFrame:
    """The images of a pattern, img_id being the name's place in names."""
    parts = [read_images(spark, pattern.format(n), F.lit(i), gray) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts)


def _raster(px: DataFrame) -> DataFrame:
    return px.withColumn("g", F.col("f")) if "g" not in px.columns else px


def framed(px: DataFrame, margin: int = 5, shape: tuple[int, int] = (512, 512)) -> DataFrame:
    """The image without its margin, which is then made anew by reflection: scans often have bad edges."""
    inner = crop(_raster(px), margin, margin, shape[0] - 2 * margin, shape[1] - 2 * margin)
    return pad(inner, margin, Border.REFLECT101, shape=(shape[0] - 2 * margin, shape[1] - 2 * margin))


def colour(spark: SparkSession, pattern: str, names=COLOUR, shape: tuple[int, int] = (512, 512), margin: int = 5) -> DataFrame:
    """Colour images guided by themselves, their margins made anew."""
    return framed(_each(spark, pattern, [f"{n:02d}" if isinstance(n, int) else n for n in names]), margin, shape)


def colour_infrared(spark: SparkSession, rgb: str, infrared: str, names=range(10), scale: float = 1.0) -> DataFrame:
    """Colour, guided by colour and infrared."""
    return paired(_each(spark, rgb, names), _each(spark, infrared, names, gray=True), scale)


def flash_pairs(spark: SparkSession, flash: str, plain: str, names=range(10), scale: float = 1.0) -> DataFrame:
    """Images without flash, guided by those with flash and by themselves."""
    with_flash = _each(spark, flash, names).select("img_id", "y", "x", F.col("f").alias("_l"))
    both = _each(spark, plain, names).join(with_flash, ["img_id", "y", "x"])
    return both.select("img_id", "y", "x", "f", F.concat("_l", F.transform("f", lambda v: v * F.lit(float(scale)))).alias("g"))


def colour_depth(spark: SparkSession, rgb: str, disparity: str, names=DEPTH, scale: float = 1.0) -> DataFrame:
    """Disparity, guided by colour and disparity."""
    both = paired(_each(spark, rgb, names), _each(spark, disparity, names, gray=True), scale)
    return both.withColumn("f", F.transform(F.slice("g", 4, 1), lambda v: v / F.lit(float(scale))))


def bands(spark: SparkSession, pattern: str, names=range(10), count: int = 33) -> DataFrame:
    """Images of `count` bands, a file for each: the pattern has the scene and the band. A missing last band repeats the one before."""
    parts = []
    for b in range(1, count + 1):
        part = reduce(DataFrame.unionByName, [read_images(spark, pattern.format(n, b), F.lit(i), True) for i, n in enumerate(names)])
        parts.append(part.withColumn("band", F.lit(b)))
    out = stacked(reduce(DataFrame.unionByName, parts), F.col("band"))
    return out.withColumn("g", F.col("f"))


def square(px: DataFrame, side: int = 512) -> DataFrame:
    """The largest square from the top left corner, scaled to `side`."""
    rows = sized(_raster(px)).withColumn("_s", F.least("_h", "_w")).where("y < _s and x < _s")
    return resize_area(rows.drop("_h", "_w", "_s"), side, side)


def prepare_infrared(rgb: DataFrame, infrared: DataFrame, side: int = 512) -> tuple[DataFrame, DataFrame]:
    """Both images scaled to side x side."""
    return resize_area(_raster(rgb), side, side), resize_area(_raster(infrared), side, side)


def prepare_depth(rgb: DataFrame, disparity: DataFrame, shape: tuple[int, int], rect: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Occlusions (zeros) of the disparity filled before and after scaling it to nearest; colour scaled by area; both cut to rect."""
    hole = F.get("f", 0) == 0
    d = resize_nearest(fill_occlusion(_raster(disparity), hole), *shape)
    d, c = fill_occlusion(d, hole), resize_area(_raster(rgb), *shape)
    return (crop(c, *rect), crop(d, *rect)) if rect else (c, d)


def prepare_bands(px: DataFrame, shape: tuple[int, int], count: int = 33, side: int = 512, multiple: int = 32) -> DataFrame:
    """Cut to multiples of 32, scaled to side x side; where there are fewer bands the last one is repeated."""
    cut = crop(_raster(px), 0, 0, floor_to(shape[0], multiple), floor_to(shape[1], multiple))
    full = lambda c: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(F.col(c), F.least(i, F.size(c) - 1)))
    return resize_area(cut.withColumns({c: full(c) for c in ("f", "g")}), side, side)
