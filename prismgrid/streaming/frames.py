"""Filtering a stream of tiles, such as frames that a camera writes.

A tile row holds its halo, so filtering is a map without state: it runs on a stream as on
a table, and nothing has to wait for a watermark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismgrid.functions import kernels
from prismgrid.model import TILES

SCHEMA = TILES


def _arrays(values: list[np.ndarray]) -> pa.ListArray:
    """A column of arrays of doubles."""
    ends = np.cumsum([0] + [len(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0)))


def filter_tiles(tiles: DataFrame, *, sigma_space: float, sigma_range: float) -> DataFrame:
    """Tiles (batch or stream) with f filtered exactly; the result has no halo. The radius is each tile's halo."""

    def run(batches):
        for batch in batches:
            places = batch.drop_columns(["f", "g"]).to_pylist()
            done = {"f": [], "g": []}
            for i, t in enumerate(places):
                r, side = t["halo"], (t["h"] + 2 * t["halo"], t["w"] + 2 * t["halo"])
                f, g = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(*side, -1) for c in ("f", "g"))
                done["f"].append(kernels.hdgf(f, g, r, sigma_space, sigma_range).ravel())
                done["g"].append(g[r : r + t["h"], r : r + t["w"]].ravel())
                t["halo"] = 0
            columns = [_arrays(done[c]) if c in done else pa.array([t[c] for t in places], pa.int32()) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return tiles.mapInArrow(run, TILES)
