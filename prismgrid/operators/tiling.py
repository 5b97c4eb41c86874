"""Tiles with a halo: one shuffle of pixels, then a kernel for each tile.

A tile gets the pixels within `halo` of it, as far as the image goes (with a wrapping
border also from the other side); the kernel extends the block beyond the image by the
border rule. Only the tile's own pixels come back, so that no pixel is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.functions.kernels import im2col, remap
from prismgrid.model import Border
from prismgrid.operators.border import sized

#: Side of a tile where neither divisions nor a size is given: a halo of 9 then adds a third.
SIDE = 128


def divided(shape: tuple[int, int], divisions: tuple[int, int]) -> tuple[int, int]:
    """The tile's size for this many divisions; they must divide the image."""
    if shape[0] % divisions[0] or shape[1] % divisions[1]:
        raise ValueError(f"{divisions} divisions do not divide an image of {shape}")
    return shape[0] // divisions[0], shape[1] // divisions[1]


def tile_index(n: Column, width: int) -> tuple[Column, Column]:
    """Row and column of tile number n in a grid that is `width` tiles wide."""
    return F.floor(n / width).cast("int"), (n % width).cast("int")


def _tiles_of(at: Column, n: Column, size: Column, halo: int, border: int) -> Column:
    """Numbers of the tiles whose extended range holds the index."""
    count = F.ceil(n / size).cast("int")
    clip = lambda i: F.sequence(F.greatest(F.floor((i - halo) / size), F.lit(0)).cast("int"), F.least(F.floor((i + halo) / size), count - 1).cast("int"))
    if border != Border.WRAP or not halo:
        return clip(at)
    turns = F.sequence(-F.ceil(halo / n).cast("int"), F.ceil(halo / n).cast("int"))
    near = F.filter(F.transform(turns, lambda t: at + t * n), lambda i: (i >= -halo) & (i < n + halo))
    return F.array_distinct(F.flatten(F.transform(near, clip)))


def _size(tile: tuple[int, int] | None, divisions: tuple[int, int] | None) -> tuple[Column, Column]:
    if tile:
        return F.lit(tile[0]), F.lit(tile[1])
    if divisions:  # the last tile is smaller where they do not divide the image
        return F.ceil(F.col("_h") / divisions[0]).cast("int"), F.ceil(F.col("_w") / divisions[1]).cast("int")
    return F.lit(SIDE), F.lit(SIDE)


def with_tiles(px: DataFrame, halo: int = 0, tile: tuple[int, int] | None = None, divisions: tuple[int, int] | None = None, border: int = Border.REFLECT101, shape: tuple[int, int] | None = None) -> DataFrame:
    """A row for each pixel and tile that needs it: px with tj, ti and the tile's size _th, _tw."""
    th, tw = _size(tile, divisions)
    rows = sized(px, shape).withColumns({"_th": th, "_tw": tw})
    rows = rows.withColumn("tj", F.explode(_tiles_of(F.col("y"), F.col("_h"), F.col("_th"), halo, border)))
    return rows.withColumn("ti", F.explode(_tiles_of(F.col("x"), F.col("_w"), F.col("_tw"), halo, border)))


def _column(table: pa.Table, name: str) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    col = table[name].combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1)


class Block:
    """A tile and its surroundings as dense arrays."""

    def __init__(self, key, table: pa.Table, halo: int, border: int):
        self.img, self.tj, self.ti = (k.as_py() for k in key)
        self.shape = table["_h"][0].as_py(), table["_w"][0].as_py()
        th, tw = table["_th"][0].as_py(), table["_tw"][0].as_py()
        self.halo, self.border = halo, border
        self.y0, self.x0 = self.tj * th, self.ti * tw
        self.h, self.w = min(th, self.shape[0] - self.y0), min(tw, self.shape[1] - self.x0)
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        self._ys, self._xs = np.unique(y), np.unique(x)
        place = np.searchsorted(self._ys, y) * len(self._xs) + np.searchsorted(self._xs, x)
        if len(place) != len(self._ys) * len(self._xs) or len(np.unique(place)) != len(place):
            raise ValueError(f"image {self.img} is not a full rectangle of single pixels")
        self._order = np.argsort(place)
        self._table = table

    def image(self, column: str, halo: int | None = None, value: float = 0.0) -> np.ndarray:
        """The tile with `halo` more pixels on each side (at most the tile's own halo)."""
        r = self.halo if halo is None else halo
        raw = _column(self._table, column)[self._order]
        raw = raw.reshape(len(self._ys), len(self._xs), raw.shape[1])
        at = [remap(np.arange(a - r, a + n + r), size, self.border) for a, n, size in ((self.y0, self.h, self.shape[0]), (self.x0, self.w, self.shape[1]))]
        out = raw[np.searchsorted(self._ys, at[0]).clip(0, len(self._ys) - 1)][:, np.searchsorted(self._xs, at[1]).clip(0, len(self._xs) - 1)]
        if self.border == Border.CONSTANT:
            out[at[0] < 0] = value
            out[:, at[1] < 0] = value
        return out

    def patches(self, column: str, halo: int, r: int) -> np.ndarray:
        """image(column, halo) with each pixel's (2r+1)^2 patch as its channels; pixels outside the image have the patch of the pixel they stand for."""
        out = im2col(self.image(column, halo + r), r)
        if self.border == Border.WRAP or not halo:  # a translation: the patches are the same
            return out
        if self.border == Border.CONSTANT:
            raise ValueError("patches need a border other than constant")
        at = [remap(np.arange(a - halo, a + n + halo), size, self.border) - (a - halo) for a, n, size in ((self.y0, self.h, self.shape[0]), (self.x0, self.w, self.shape[1]))]
        return out[at[0].clip(0, out.shape[0] - 1)][:, at[1].clip(0, out.shape[1] - 1)]

    def inside(self, halo: int | None = None) -> np.ndarray | None:
        """Which of image()'s pixels lie in the image; None if all count."""
        if self.border != Border.CONSTANT:
            return None
        r = self.halo if halo is None else halo
        y, x = (np.arange(a - r, a + n + r) for a, n in ((self.y0, self.h), (self.x0, self.w)))
        return ((y >= 0) & (y < self.shape[0]))[:, None] & ((x >= 0) & (x < self.shape[1]))[None, :]


def _rows(block: Block, **columns: np.ndarray) -> pa.Table:
    """A pixel table from images over the tile's own pixels."""
    y, x = np.divmod(np.arange(block.h * block.w), block.w)
    out = {"img_id": pa.array(np.full(len(y), block.img), pa.int32()), "y": pa.array((y + block.y0).astype(np.int32)), "x": pa.array((x + block.x0).astype(np.int32))}
    for name, image in columns.items():
        flat = np.ascontiguousarray(image, float).reshape(block.h * block.w, -1)
        out[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
    return pa.table(out)


def apply_tiles(px: DataFrame, kernel: Callable[[Block], np.ndarray], halo: int, border: int = Border.REFLECT101, tile: tuple[int, int] | None = None, divisions: tuple[int, int] | None = None, shape: tuple[int, int] | None = None, keep_guide: bool = True, into: str = "f") -> DataFrame:
    """px with f (or g, by `into`) replaced by what the kernel makes of each tile: an image over the tile's own pixels."""
    columns = ["img_id", "y", "x", "f", "g", "tj", "ti", "_h", "_w", "_th", "_tw"]
    rows = with_tiles(px, halo, tile, divisions, border, shape).select(*columns)

    def run(key, table):
        block = Block(key, table, halo, border)
        out = kernel(block)
        if into == "g":
            return _rows(block, f=block.image("f", 0), g=out)
        return _rows(block, f=out, g=block.image("g", 0)) if keep_guide else _rows(block, f=out)

    schema = "img_id int, y int, x int, f array<double>" + ", g array<double>" * keep_guide
    return rows.groupBy("img_id", "tj", "ti").applyInArrow(run, schema)


def to_tiles(px: DataFrame, halo: int = 0, border: int = Border.REFLECT101, tile: tuple[int, int] | None = None, divisions: tuple[int, int] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """A row a tile with its pixels and halo as arrays, row by row with channels interleaved."""
    rows = with_tiles(px, halo, tile, divisions, border, shape).select("img_id", "y", "x", "f", "g", "tj", "ti", "_h", "_w", "_th", "_tw")

    def run(key, table):
        b = Block(key, table, halo, border)
        one = {"img_id": b.img, "tj": b.tj, "ti": b.ti, "y0": b.y0, "x0": b.x0, "h": b.h, "w": b.w, "halo": halo, "f": b.image("f").ravel(), "g": b.image("g").ravel()}
        return pa.table({k: pa.array([v], pa.list_(pa.float64()) if isinstance(v, np.ndarray) else pa.int32()) for k, v in one.items()})

    return rows.groupBy("img_id", "tj", "ti").applyInArrow(run, "img_id int, tj int, ti int, y0 int, x0 int, h int, w int, halo int, f array<double>, g array<double>")


def from_tiles(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles, halos dropped: no shuffle."""

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.drop_columns(["f", "g"]).to_pylist()):
                side = t["h"] + 2 * t["halo"], t["w"] + 2 * t["halo"]
                r = t["halo"]
                own = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(*side, -1)[r : r + t["h"], r : r + t["w"]] for c in ("f", "g")}
                place = type("Place", (), {"img": t["img_id"], "y0": t["y0"], "x0": t["x0"], "h": t["h"], "w": t["w"]})
                yield from _rows(place, **own).to_batches()

    return tiles.mapInArrow(run, "img_id int, y int, x int, f array<double>, g array<double>")
