"""Tables as rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_from_table(df: DataFrame, y: Column, x: Column, signal: list[Column], guide: list[Column] | None = None, img: Column | None = None) -> DataFrame:
    """A raster from a table with a row a pixel: coordinates, signal and guide as expressions of its columns."""
    channels = lambda cols: F.array(*(c.cast("double") for c in cols))
    return df.select((F.lit(0) if img is None else img).cast("int").alias("img_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), channels(signal).alias("f"), channels(guide or signal).alias("g"))


def events_grid(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """The events table as one image, `width` wide: the signal is value, the guide value and the number k of props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "props")
    k = F.get_json_object("props", "$.k")
    at = F.col("event_id")
    # the image's number is computed from the row: joins on a constant would be left without a key
    return grid_from_table(e, F.floor(at / width), at % width, [F.col("value")], [F.col("value"), k], at * 0)


def part_grid(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    """The part table as one image of two channels, size and price."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    at = F.col("p_partkey")
    return grid_from_table(p, F.floor(at / width), at % width, [F.col("p_size"), F.col("p_retailprice")], img=at * 0)
