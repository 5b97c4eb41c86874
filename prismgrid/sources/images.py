"""Image files as pixels, and pixels as PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of red, green and blue in luminance (ITU-R BT.601).
LUMA = (0.299, 0.587, 0.114)


def read_images(spark: SparkSession, path: str | list[str], img_id: Column | None = None, gray: bool = False) -> DataFrame:
    """img_id, y, x, f (red, green, blue or one channel, 0..255) of all images under a path.

    img_id: an expression of `origin`, the file's name; by default its first number. A file
    that cannot be read as an image raises.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ident = F.regexp_extract("origin", r"(\d+)[^/\d]*$", 1).cast("int") if img_id is None else img_id.cast("int")
    raw = raw.select(ident.alias("img_id"), F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("no image: "), "origin"))).alias("height"), "width", "nChannels", "data")

    def pixels(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, w, c = r["height"], r["width"], r["nChannels"]
                v = np.frombuffer(r["data"], np.uint8).reshape(h * w, c).astype(float)
                v = v[:, 2::-1] if c >= 3 else v  # stored blue first; alpha is dropped
                if gray and v.shape[1] > 1:
                    v = (v @ np.array(LUMA))[:, None]
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                f = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, r["img_id"]), pa.int32()), pa.array(y), pa.array(x), f], ["img_id", "y", "x", "f"])

    return raw.mapInArrow(pixels, "img_id int, y int, x int, f array<double>")


def stacked(bands: DataFrame, band: Column) -> DataFrame:
    """One image from several with one channel each: rows of (img_id, y, x, f) joined in order of `band`."""
    rows = bands.groupBy("img_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct(band.alias("b"), F.get("f", 0).alias("v")))).alias("p"))
    return rows.select("img_id", "y", "x", F.col("p.v").alias("f"))


def paired(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """Signal a, guide a with scaled b behind it, by pixel."""
    both = a.join(b.select("img_id", "y", "x", F.col("f").alias("_b")), ["img_id", "y", "x"])
    return both.select("img_id", "y", "x", "f", F.concat("f", F.transform("_b", lambda v: v * F.lit(float(scale)))).alias("g"))


def png(image: np.ndarray) -> bytes:
    """A PNG file of an (h, w, 1 or 3) image, values rounded and kept within 0..255."""
    v = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    h, w, c = v.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + line.tobytes() for line in v)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_png(px: DataFrame) -> DataFrame:
    """img_id, png: a file's bytes for each image of 1 or 3 channels."""

    def run(key, table):
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        f = table["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        image = np.zeros((y.max() + 1, x.max() + 1, f.shape[1]))
        image[y, x] = f
        return pa.table({"img_id": pa.array([key[0].as_py()], pa.int32()), "png": pa.array([png(image)], pa.binary())})

    return px.select("img_id", "y", "x", "f").groupBy("img_id").applyInArrow(run, "img_id int, png binary")


def save_png(px: DataFrame, folder: str, name: str = "{}.png") -> list[str]:
    """Writes a file for each image to a folder of the driver, one at a time."""
    out = []
    for row in to_png(px).toLocalIterator():
        out.append(f"{folder}/{name.format(row.img_id)}")
        with open(out[-1], "wb") as f:
            f.write(bytes(row.png))
    return out


def write_dataset(px: DataFrame, path: str) -> None:
    """Pixels as Parquet, a folder for each image."""
    px.write.mode("overwrite").partitionBy("img_id").parquet(path)
