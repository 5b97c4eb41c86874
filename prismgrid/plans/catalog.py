"""The filtering queries by name, with their SQL for DuckDB.

The queries run over the events table as an image, 100 pixels wide (FIXTURES.md). The SQL is
a plain definition of what each operator computes: gathers of neighbours by joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions.metrics import psnr, statistics
from prismgrid.model import Border, Cluster, FilterSpec, Sampler, Signal, Smoother, Variant
from prismgrid.operators import border, channels, cluster, exact, pca, resample, sampling
from prismgrid.operators.approximate import cluster_filter, kd_tree_filter, kernel_eigenvalues, lattice_filter, tile_centres
from prismgrid.operators.patches import im2col
from prismgrid.operators.spatial import gaussian
from prismgrid.operators.tiling import from_tiles, tile_index, to_tiles, with_tiles
from prismgrid.plans import sql_clusters
from prismgrid.plans.methods import run_cell, run_method
from prismgrid.sources.grid import events_grid, part_grid
from prismgrid.sources.images import stacked
from prismgrid.sources.scenes import framed

SS, SR, R = 3.0, 40.0, 3
_LAMBDA = 0.05


def _value(px: DataFrame, name: str = "v", column: str = "f") -> DataFrame:
    """y, x and the first channel, rounded for comparison."""
    return px.select("y", "x", F.round(F.get(column, 0), 6).alias(name))


def _height(spark, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.floor(F.col("event_id") / 100)) + 1).first()[0]


# ---- SQL pieces ----------------------------------------------------------------------

_GRID = """g AS (
  SELECT CAST(event_id // 100 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x, value AS f0, value AS g0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS g1 FROM events
), s AS (SELECT CAST(max(y) + 1 AS INTEGER) AS h, 100 AS w FROM g)"""


def _mod(a: str, n: str) -> str:
    return f"((({a}) % ({n}) + ({n})) % ({n}))"


def _map(i: str, n: str, kind: int) -> str:
    """SQL of border.remapped()."""
    if kind == Border.REPLICATE:
        return f"least(greatest({i}, 0), {n} - 1)"
    if kind == Border.WRAP:
        return _mod(i, n)
    if kind == Border.REFLECT:
        m = _mod(i, f"2 * {n}")
        return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END"
    if kind == Border.REFLECT101:
        m = _mod(i, f"greatest(2 * ({n} - 1), 1)")
        return f"CASE WHEN {n} = 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE 2 * ({n} - 1) - {m} END"
    return f"CASE WHEN ({i}) >= 0 AND ({i}) < {n} THEN {i} END"


def _taps(r: int, kind: int = Border.REFLECT101) -> str:
    """A row for each pixel p and tap q of its window: y, x, dy, dx and q's columns."""
    return f"""tm AS MATERIALIZED (
  SELECT p.y, p.x, p.g0 AS p0, p.g1 AS p1, a.d AS dy, b.d AS dx, {_map("p.y + a.d", "s.h", kind)} AS qy, {_map("p.x + b.d", "s.w", kind)} AS qx
  FROM g p CROSS JOIN s CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS d) a CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS d) b
), t AS (SELECT tm.*, q.f0, q.g0, q.g1 FROM tm JOIN g q ON q.y = tm.qy AND q.x = tm.qx)"""


def _hdgf(r: int, kind: int = Border.REFLECT101, guide: tuple[str, ...] = ("0", "1")) -> str:
    d = " + ".join(f"(g{c} - p{c}) * (g{c} - p{c})" for c in guide)
    w = f"exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE - ({d}) / {2 * SR * SR}::DOUBLE)"
    return f"WITH {_GRID}, {_taps(r, kind)} SELECT y, x, round(sum({w} * f0) / sum({w}), 6) AS v FROM t GROUP BY y, x"


def _separable(weights: str, r: int = 9, value: str = "f0") -> str:
    """Two passes along columns and lines with the weights of table k(n, wt)."""
    return f"""{weights}, m1 AS MATERIALIZED (SELECT p.y, p.x, k.wt, {_map("p.y + k.n", "s.h", Border.REFLECT101)} AS qy FROM g p CROSS JOIN s CROSS JOIN k
), v1 AS MATERIALIZED (SELECT m1.y, m1.x, sum(wt * q.{value}) AS v FROM m1 JOIN g q ON q.x = m1.x AND q.y = m1.qy GROUP BY m1.y, m1.x
), m2 AS MATERIALIZED (SELECT p.y, p.x, k.wt, {_map("p.x + k.n", "s.w", Border.REFLECT101)} AS qx FROM v1 p CROSS JOIN s CROSS JOIN k
), v2 AS (SELECT m2.y, m2.x, sum(wt * q.v) AS v FROM m2 JOIN v1 q ON q.y = m2.y AND q.x = m2.qx GROUP BY m2.y, m2.x)"""


def _gauss(r: int = 9, sigma: float = SS) -> str:
    two = 2 * sigma * sigma
    return f"""e AS (SELECT CAST(unnest(range(-{r}, {r} + 1)) AS INTEGER) AS n), k AS (
  SELECT n, exp(-CAST(n * n AS DOUBLE) / {two}::DOUBLE) / (SELECT sum(exp(-CAST(n * n AS DOUBLE) / {two}::DOUBLE)) FROM e) AS wt FROM e
)"""


def _cosine(r: int = 9, order: int = 2) -> str:
    t = 2 * r + 1
    return f"""e AS (SELECT CAST(unnest(range(-{r}, {r} + 1)) AS INTEGER) AS n), gk AS (
  SELECT n, exp(-CAST(n * n AS DOUBLE) / {2 * SS * SS}::DOUBLE) / (SELECT sum(exp(-CAST(n * n AS DOUBLE) / {2 * SS * SS}::DOUBLE)) FROM e) AS wt FROM e
), o AS (SELECT CAST(unnest(range(0, {order} + 1)) AS INTEGER) AS o), a AS (
  SELECT o, CASE WHEN o = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / {t} * sum(wt * cos(2 * pi() * o * n / {t})) AS a FROM gk CROSS JOIN o GROUP BY o
), k AS (SELECT n, sum(a * cos(2 * pi() * o * n / {t})) AS wt FROM e CROSS JOIN a GROUP BY n)"""


def _centres(n: int) -> str:
    return f"c AS (SELECT x AS k, g0 AS m0, g1 AS m1 FROM g WHERE y = 0 AND x < {n})"


_ASSIGNED = """a AS (
  SELECT y, x, f0, g0, g1, k, d FROM (
    SELECT g.*, c.k, (g0 - m0) * (g0 - m0) + (g1 - m1) * (g1 - m1) AS d,
           row_number() OVER (PARTITION BY y, x ORDER BY (g0 - m0) * (g0 - m0) + (g1 - m1) * (g1 - m1), k) AS n FROM g CROSS JOIN c
  ) WHERE n = 1
)"""


def _first(px: DataFrame, n: int) -> list[list[float]]:
    """The guides of the first n pixels, as centres for comparison."""
    return [list(r.g) for r in px.where(f"y = 0 and x < {n}").orderBy("x").select("g").collect()]


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


# ---- the exact filter ----------------------------------------------------------------


@_query(_hdgf(R))
def hdgf_exact(spark, sf_dir):
    """Joint bilateral filter of the grid, radius 3."""
    return _value(exact.hdgf(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, radius=R))


@_query(_hdgf(R, guide=("0",)))
def hdgf_self_guided(spark, sf_dir):
    """Bilateral filter: the signal is its own guide."""
    px = events_grid(spark, sf_dir).withColumn("g", F.col("f"))
    return _value(exact.hdgf(px, sigma_space=SS, sigma_range=SR, radius=R))


@_query(_hdgf(R))
def hdgf_tiled(spark, sf_dir):
    """The same in 5 x 5 tiles."""
    return _value(exact.hdgf(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, radius=R, divisions=(5, 5)))


@_query(_hdgf(2))
def hdgf_join(spark, sf_dir):
    """The same as a join and an aggregate, radius 2."""
    return _value(exact.hdgf(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, radius=2, plan="join"))


for _b in (Border.CONSTANT, Border.REPLICATE, Border.REFLECT, Border.WRAP):

    @_query(_hdgf(R, _b), f"hdgf_{_b.name.lower()}")
    def _bordered(spark, sf_dir, kind=_b):
        """The filter with another border rule."""
        return _value(exact.hdgf(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, radius=R, border=kind, tile=(5, 20)))


_PATCH = f"""WITH {_GRID}, o AS (SELECT CAST(unnest(range(-1, 2)) AS INTEGER) AS d), bm AS MATERIALIZED (
  SELECT p.y, p.x, (a.d + 1) * 3 + c.d + 1 AS pos, {_map("p.y + a.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + c.d", "s.w", Border.REFLECT101)} AS qx FROM g p CROSS JOIN s CROSS JOIN o a CROSS JOIN o c
), b AS MATERIALIZED (SELECT bm.y, bm.x, pos, q.f0 AS v FROM bm JOIN g q ON q.y = qy AND q.x = qx)"""


@_query(f"""{_PATCH}, u AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS d), t AS MATERIALIZED (
  SELECT p.y, p.x, a.d AS dy, c.d AS dx, {_map("p.y + a.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + c.d", "s.w", Border.REFLECT101)} AS qx FROM g p CROSS JOIN s CROSS JOIN u a CROSS JOIN u c
), d AS (
  SELECT t.y, t.x, t.dy, t.dx, qy, qx, sum((m.v - n.v) * (m.v - n.v)) AS d FROM t JOIN b m ON m.y = t.y AND m.x = t.x JOIN b n ON n.y = qy AND n.x = qx AND n.pos = m.pos GROUP BY ALL
), w AS (SELECT d.y, d.x, exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE - d / {2 * SR * SR}::DOUBLE) AS wt, g.f0 FROM d JOIN g ON g.y = qy AND g.x = qx)
SELECT y, x, round(sum(wt * f0) / sum(wt), 6) AS v FROM w GROUP BY y, x""")
def nlm_exact(spark, sf_dir):
    """Non-local means: the guide is the 3 x 3 patch of the signal, radius 2."""
    return _value(exact.hdgf(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, radius=2, patch=1, column="f"))


@_query("""WITH p AS (SELECT a.vec_id AS id, b.embedding AS e, exp(-list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]))) / 0.5::DOUBLE) AS w FROM embeddings a CROSS JOIN embeddings b)
SELECT id, round(sum(w * CAST(e[1] AS DOUBLE)) / sum(w), 6) AS v0, round(sum(w * CAST(e[64] AS DOUBLE)) / sum(w), 6) AS v63 FROM p GROUP BY id""")
def embedding_kernel_smooth(spark, sf_dir):
    """Every embedding as the mean of all, weighted by the Gaussian of their distance (sigma 0.5)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    return exact.range_smooth(e, sigma_range=0.5).select("id", F.round(F.get("f", 0), 6).alias("v0"), F.round(F.get("f", 63), 6).alias("v63"))


# ---- spatial smoothing ---------------------------------------------------------------


@_query(f"WITH {_GRID}, {_separable(_gauss())} SELECT y, x, round(v, 6) AS v FROM v2")
def gaussian_fir(spark, sf_dir):
    """Gaussian smoothing with 19 taps an axis."""
    return _value(gaussian(events_grid(spark, sf_dir), sigma_space=SS, radius=9))


@_query(f"WITH {_GRID}, {_separable(_cosine())} SELECT y, x, round(v, 6) AS v FROM v2")
def gaussian_sliding_cosine(spark, sf_dir):
    """The same by a cosine series of order 2, in constant time."""
    return _value(gaussian(events_grid(spark, sf_dir), sigma_space=SS, radius=9, how=Smoother.SLIDING_COSINE, order=2))


# ---- borders, channels, resampling ---------------------------------------------------

for _b in Border:
    _to = f"""WITH {_GRID}, z AS (SELECT CAST(i // (w + 6) AS INTEGER) AS y, CAST(i % (w + 6) AS INTEGER) AS x, h, w FROM s, unnest(range(0, (h + 6) * (w + 6))) AS u(i)),
zm AS MATERIALIZED (SELECT y, x, {_map("(y - 3)", "h", _b)} AS qy, {_map("(x - 3)", "w", _b)} AS qx FROM z)
SELECT zm.y, zm.x, round(coalesce(q.f0, 7.0::DOUBLE), 6) AS v FROM zm LEFT JOIN g q ON q.y = qy AND q.x = qx"""

    @_query(_to, f"pad_{_b.name.lower()}")
    def _padded(spark, sf_dir, kind=_b):
        """The grid with three more pixels on each side."""
        return _value(border.pad(events_grid(spark, sf_dir), 3, kind, value=7.0))


@_query(f"WITH {_GRID} SELECT y - 2 AS y, x - 10 AS x, round(f0, 6) AS v FROM g WHERE y BETWEEN 2 AND 7 AND x BETWEEN 10 AND 49")
def crop_recenter(spark, sf_dir):
    """A rectangle at coordinates from 0."""
    return _value(border.crop(events_grid(spark, sf_dir), 2, 10, 6, 40))


@_query(f"WITH {_GRID} SELECT y, x, 0 AS c, round(g0, 6) AS v FROM g UNION ALL SELECT y, x, 1, round(g1, 6) FROM g")
def channel_split(spark, sf_dir):
    """A row for each channel of the guide."""
    return channels.split(events_grid(spark, sf_dir), "g").select("y", "x", "c", F.round("v", 6).alias("v"))


@_query(f"WITH {_GRID} SELECT y, x, round(f0, 6) AS c0, round(g0 * 0.25::DOUBLE, 6) AS c1, round(g1 * 0.25::DOUBLE, 6) AS c2 FROM g")
def channel_merge_lambda(spark, sf_dir):
    """The signal's channels, then the guide's times 0.25; split and merged on the way."""
    px = events_grid(spark, sf_dir)
    px = px.drop("g").join(channels.merge(channels.split(px, "g"), "g"), ["img_id", "y", "x"])
    both = channels.concat_scaled(F.col("f"), F.col("g"), 0.25)
    return px.select("y", "x", *(F.round(F.get(both, i), 6).alias(f"c{i}") for i in range(3)))


def _u8(v: str) -> str:
    return f"CAST(least(greatest(round_even({v}, 0), 0), 255) AS INTEGER)"


@_query(f"WITH {_GRID} SELECT y, x, {_u8('f0')} AS c0, {_u8('g1 * 0.5::DOUBLE')} AS c1 FROM g")
def channel_merge_u8(spark, sf_dir):
    """Concatenation as 8-bit values, converted after the product."""
    both = channels.concat_scaled(F.col("f"), F.slice("g", 2, 1), 0.5, u8=True)
    return events_grid(spark, sf_dir).select("y", "x", *(F.get(both, i).cast("int").alias(f"c{i}") for i in range(2)))


@_query(f"WITH {_GRID} SELECT y, x, {_u8('f0 * 1.7::DOUBLE - 20')} AS v FROM g")
def depth_to_u8(spark, sf_dir):
    """Values rounded half to even and kept within 0..255."""
    return events_grid(spark, sf_dir).select("y", "x", channels.to_u8(F.get("f", 0) * 1.7 - 20).alias("v"))


@_query(f"WITH {_GRID} SELECT y, x, round(CAST(CAST(g0 AS FLOAT) AS DOUBLE), 5) AS v FROM g")
def depth_to_float(spark, sf_dir):
    """Values as 32-bit floats."""
    return channels.as_float(events_grid(spark, sf_dir), "g").select("y", "x", F.round(F.get("g", 0), 5).alias("v"))


@_query(f"WITH {_GRID} SELECT y, x, round(0.3::DOUBLE * g0 + 0.7::DOUBLE * g1, 6) AS v FROM g")
def alpha_blend(spark, sf_dir):
    """0.3 of one image and 0.7 of another."""
    px = events_grid(spark, sf_dir).withColumn("f", channels.blend(F.slice("g", 1, 1), F.slice("g", 2, 1), 0.3))
    return _value(px)


@_query(f"WITH {_GRID} SELECT y, x, round((g0 - g1) * 4, 6) AS v FROM g")
def diff_amplify(spark, sf_dir):
    """A difference times 2^2."""
    px = events_grid(spark, sf_dir).withColumn("f", channels.amplified_difference(F.slice("g", 1, 1), F.slice("g", 2, 1), 2))
    return _value(px)


@_query(f"WITH {_GRID} SELECT y, x, round((g0 + g1) / 2, 6) AS v FROM g")
def gray_average(spark, sf_dir):
    """The mean of the channels."""
    return events_grid(spark, sf_dir).select("y", "x", F.round(channels.average_gray(F.col("g")), 6).alias("v"))


@_query(f"WITH {_GRID} SELECT y, x, round(0.5::DOUBLE * g0 + 0.25::DOUBLE * g1, 6) AS c0, round(g1 - g0, 6) AS c1 FROM g")
def band_preview(spark, sf_dir):
    """A fixed linear map of the channels."""
    out = channels.linear_map(F.col("g"), [[0.5, 0.25], [-1.0, 1.0]])
    return events_grid(spark, sf_dir).select("y", "x", *(F.round(F.get(out, i), 6).alias(f"c{i}") for i in range(2)))


@_query(f"{_PATCH} SELECT y, x, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM b")
def im2col_r1(spark, sf_dir):
    """3 x 3 patches as channels."""
    return im2col(events_grid(spark, sf_dir), 1, column="f").select("y", "x", F.posexplode("g").alias("pos", "v")).withColumn("v", F.round("v", 6))


@_query(f"WITH {_GRID} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(f0), 5) AS v FROM g GROUP BY ALL")
def resize_area_2x(spark, sf_dir):
    """Means of 2 x 2 pixels."""
    return resample.shrink(events_grid(spark, sf_dir), 2).select("y", "x", F.round(F.get("f", 0), 5).alias("v"))


@_query(f"""WITH {_GRID}, o AS (
  SELECT g.f0, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x,
         least((g.y + 1) * 0.4::DOUBLE, a.i + 1) - greatest(g.y * 0.4::DOUBLE, a.i) AS wy, least((g.x + 1) * 0.35::DOUBLE, b.i + 1) - greatest(g.x * 0.35::DOUBLE, b.i) AS wx
  FROM g CROSS JOIN s JOIN (SELECT unnest(range(0, 2000)) AS i) a ON a.i < h * 2 // 5 AND (g.y + 1) * 0.4::DOUBLE > a.i + 1e-9 AND g.y * 0.4::DOUBLE < a.i + 1 - 1e-9
  JOIN (SELECT unnest(range(0, 35)) AS i) b ON (g.x + 1) * 0.35::DOUBLE > b.i + 1e-9 AND g.x * 0.35::DOUBLE < b.i + 1 - 1e-9
) SELECT y, x, round(sum(f0 * wy * wx) / sum(wy * wx), 5) AS v FROM o GROUP BY y, x""")
def resize_area_fraction(spark, sf_dir):
    """Scaled to 0.4 of the height and 0.35 of the width, by overlap."""
    h = _height(spark, sf_dir)
    return resample.resize_area(events_grid(spark, sf_dir), h * 2 // 5, 35, (h, 100)).select("y", "x", F.round(F.get("f", 0), 5).alias("v"))


@_query(f"""WITH {_GRID}, z AS (SELECT CAST(i // 130 AS INTEGER) AS y, CAST(i % 130 AS INTEGER) AS x, h FROM s, unnest(range(0, CAST(h * 3 // 5 AS BIGINT) * 130)) AS u(i)),
zm AS MATERIALIZED (SELECT y, x, y * h // (h * 3 // 5) AS qy, x * 100 // 130 AS qx FROM z)
SELECT zm.y, zm.x, round(q.f0, 6) AS v FROM zm JOIN g q ON q.y = qy AND q.x = qx""")
def resize_nearest(spark, sf_dir):
    """Scaled to 0.6 of the height and 1.3 of the width, nearest pixel."""
    h = _height(spark, sf_dir)
    return _value(resample.resize_nearest(events_grid(spark, sf_dir), h * 3 // 5, 130, (h, 100)))


@_query(f"""WITH {_GRID}, m AS (SELECT *, CASE WHEN f0 >= 30 THEN f0 END AS u FROM g), n AS (
  SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
         first_value(u IGNORE NULLS) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM m
) SELECT y, x, round(coalesce(u, least(a, b), f0), 6) AS v FROM n""")
def fill_occlusion(spark, sf_dir):
    """Values below 30 filled from the line's nearest others, the smaller one."""
    return _value(resample.fill_occlusion(events_grid(spark, sf_dir), F.get("f", 0) < 30))


@_query(f"WITH {_GRID} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x + 100 * (y % 2) AS INTEGER) AS x, round(f0, 6) AS v FROM g")
def mosaic(spark, sf_dir):
    """The grid's even and odd lines as two images side by side."""
    px = events_grid(spark, sf_dir)
    px = px.withColumns({"img_id": F.col("y") % 2, "y": F.floor(F.col("y") / 2).cast("int")})
    return _value(resample.mosaic(px, 2, _height(spark, sf_dir) // 2, 100))


@_query("SELECT CAST(event_id AS INTEGER) AS n, CAST(event_id // 8 AS INTEGER) AS tj, CAST(event_id % 8 AS INTEGER) AS ti FROM events")
def tile_number(spark, sf_dir):
    """Row and column of a tile's number in a grid 8 wide."""
    j, i = tile_index(F.col("event_id"), 8)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("int").alias("n"), j.alias("tj"), i.alias("ti"))


@_query(f"""WITH {_GRID}, t AS (SELECT CAST(a.i AS INTEGER) AS tj, CAST(b.i AS INTEGER) AS ti, h // 5 AS th, 20 AS tw FROM s, (SELECT unnest(range(0, 5)) AS i) a, (SELECT unnest(range(0, 5)) AS i) b)
SELECT tj, ti, count(*) AS n, round(sum(f0), 4) AS total FROM t JOIN g ON g.y >= tj * th - 3 AND g.y < (tj + 1) * th + 3 AND g.x >= ti * tw - 3 AND g.x < (ti + 1) * tw + 3 GROUP BY tj, ti""")
def tile_halo(spark, sf_dir):
    """Pixels that each of 5 x 5 tiles gets with a halo of 3."""
    rows = with_tiles(events_grid(spark, sf_dir), 3, divisions=(5, 5))
    return rows.groupBy("tj", "ti").agg(F.count("*").alias("n"), F.round(F.sum(F.get("f", 0)), 4).alias("total"))


@_query(f"WITH {_GRID} SELECT y, x, round(f0, 6) AS v FROM g")
def tile_round_trip(spark, sf_dir):
    """Pixels packed into tiles with a halo and taken out again."""
    return _value(from_tiles(to_tiles(events_grid(spark, sf_dir), 3, divisions=(2, 5))))


# ---- sampling and clustering ---------------------------------------------------------


@_query(f"WITH {_GRID} SELECT y, x, round(f0, 6) AS v FROM g WHERE y % 2 = 0 AND x % 2 = 0")
def sample_stride(spark, sf_dir):
    """A quarter of the pixels."""
    return _value(sampling.stride(events_grid(spark, sf_dir), 0.25))


_GRADIENT = f"""WITH {_GRID}, em AS MATERIALIZED (
  SELECT g.*, {_map("y - 1", "h", Border.REFLECT101)} AS up, {_map("y + 1", "h", Border.REFLECT101)} AS down, {_map("x - 1", "w", Border.REFLECT101)} AS lef, {_map("x + 1", "w", Border.REFLECT101)} AS rig FROM g CROSS JOIN s
), e AS (
  SELECT p.y, p.x, p.f0, round((abs(u.g0 - d.g0) / 2 + abs(u.g1 - d.g1) / 2) + (abs(l.g0 - r.g0) / 2 + abs(l.g1 - r.g1) / 2), 6) AS e FROM em p
  JOIN g u ON u.x = p.x AND u.y = p.up JOIN g d ON d.x = p.x AND d.y = p.down JOIN g l ON l.y = p.y AND l.x = p.lef JOIN g r ON r.y = p.y AND r.x = p.rig
)"""


@_query(f"{_GRADIENT} SELECT y, x, e FROM e")
def gradient(spark, sf_dir):
    """Absolute central differences, summed over the guide's channels."""
    return sampling.with_gradient(events_grid(spark, sf_dir)).select("y", "x", F.round("gradient", 6).alias("e"))


@_query(f"{_GRADIENT}, n AS (SELECT *, row_number() OVER (PARTITION BY y // 2, x // 2 ORDER BY e DESC, y, x) AS n FROM e) SELECT y, x, round(f0, 6) AS v FROM n WHERE n = 1")
def sample_gradient_max(spark, sf_dir):
    """The pixel with the largest gradient of each 2 x 2 block, by six decimals."""
    return _value(sampling.gradient_max(events_grid(spark, sf_dir), 0.25, decimals=6))


@_query(f"""WITH {_GRID}, q AS (SELECT CAST(CAST(floor(g0 / 50) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(g1 / 50) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n, avg(g0) AS a, avg(g1) AS b FROM g GROUP BY cell)
SELECT cell, n, round(a, 6) AS m0, round(b, 6) AS m1 FROM q ORDER BY n DESC, cell LIMIT 8""")
def quantize_div(spark, sf_dir):
    """The eight fullest cells of a regular grid over the guide."""
    out = cluster.uniform_cells(events_grid(spark, sf_dir), 50, 8)
    return out.select("cell", "n", *(F.round(F.get("mu", i), 6).alias(f"m{i}") for i in range(2)))


@_query(f"WITH {_GRID}, {_centres(5)}, {_ASSIGNED} SELECT y, x, CAST(k AS INTEGER) AS k, round(d, 5) AS d FROM a")
def kmeans_assign(spark, sf_dir):
    """The nearest of five centres."""
    px = events_grid(spark, sf_dir)
    return cluster.assign(px, _first(px, 5)).select("y", "x", "k", F.round("d", 5).alias("d"))


@_query(f"WITH {_GRID}, {_centres(5)}, {_ASSIGNED} SELECT CAST(k AS INTEGER) AS k, round(sum(1.0::DOUBLE), 6) AS weight, round(sum(g0) / count(*), 6) AS m0, round(sum(g1) / count(*), 6) AS m1 FROM a GROUP BY k")
def kmeans_step(spark, sf_dir):
    """The means of the pixels nearest to five centres."""
    px = events_grid(spark, sf_dir)
    return cluster.step(px, _first(px, 5)).select("k", F.round("weight", 6).alias("weight"), *(F.round(F.get("mu", i), 6).alias(f"m{i}") for i in range(2)))


@_query(f"""WITH {_GRID}, {_centres(5)}, {_ASSIGNED}, b AS (SELECT *, 1 - exp(-d / 1250.0::DOUBLE) AS wt FROM a)
SELECT CAST(k AS INTEGER) AS k, round(sum(wt), 6) AS weight, round(sum(wt * g0) / sum(wt), 6) AS m0, round(sum(wt * g1) / sum(wt), 6) AS m1 FROM b GROUP BY k HAVING sum(wt) > 1e-12""")
def gauss_inv_means_step(spark, sf_dir):
    """The same with weights that vanish near a centre (sigma 25)."""
    px = events_grid(spark, sf_dir)
    return cluster.step(px, _first(px, 5), sigma=25.0).select("k", F.round("weight", 6).alias("weight"), *(F.round(F.get("mu", i), 6).alias(f"m{i}") for i in range(2)))


@_query(f"""WITH {_GRID}, w AS (SELECT max(g0) - min(g0) >= max(g1) - min(g1) AS z, median(g0) AS a, median(g1) AS b FROM g),
p AS (SELECT g0, g1, CASE WHEN z THEN g0 > a ELSE g1 > b END AS side FROM g CROSS JOIN w)
SELECT round(median(g0), 6) AS m0, round(median(g1), 6) AS m1 FROM p GROUP BY side""")
def median_cut_1level(spark, sf_dir):
    """The medians of the two halves along the wider channel."""
    px = events_grid(spark, sf_dir)
    mu = cluster.box_centres(px, cluster.cut_boxes(px, 2))
    return spark.createDataFrame([tuple(m) for m in mu], "m0 double, m1 double").select(F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))


def _soft(k: int) -> str:
    taps = f"""q AS (SELECT g.y, g.x, g.f0, c.k, exp(-((g0 - m0) * (g0 - m0) + (g1 - m1) * (g1 - m1)) / {2 * SR * SR}::DOUBLE) AS c, sqrt((g0 - m0) * (g0 - m0) + (g1 - m1) * (g1 - m1)) AS far FROM g CROSS JOIN c),
w AS MATERIALIZED (SELECT p.y, p.x, a.d AS dy, b.d AS dx, {_map("p.y + a.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + b.d", "s.w", Border.REFLECT101)} AS qx FROM g p CROSS JOIN s CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) a CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) b),
h AS (SELECT w.y, w.x, q.k, sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE) * c * f0) / sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE) * c) AS h FROM w JOIN q ON q.y = qy AND q.x = qx GROUP BY w.y, w.x, q.k)"""
    return f"WITH {_GRID}, {_centres(k)}, {taps}"


def _blended(spark, sf_dir, **changes):
    import numpy as np

    from prismgrid.functions import lowrank
    from prismgrid.operators.tiling import apply_tiles

    px = events_grid(spark, sf_dir)
    mu = np.array(_first(px, 4))
    spec = FilterSpec(sigma_space=SS, sigma_range=SR, radius=R, variant=Variant.SOFT, smoother=Smoother.FIR, soft_lambda=_LAMBDA).but(**changes)
    return _value(apply_tiles(px, lambda b: lowrank.filtered(b.image("f"), b.image("g"), mu, spec, R), R, divisions=(5, 5)))


@_query(f"""{_soft(4)} SELECT h.y, h.x, round(sum(exp(-{_LAMBDA}::DOUBLE * far) * h) / sum(exp(-{_LAMBDA}::DOUBLE * far)), 6) AS v FROM h JOIN q USING (y, x, k) GROUP BY h.y, h.x""")
def soft_interp_k4(spark, sf_dir):
    """Four component images blended by the distance to their centres."""
    return _blended(spark, sf_dir)


@_query(f"{_soft(4)} SELECT y, x, round(h, 6) AS v FROM h WHERE k = 2")
def component_image(spark, sf_dir):
    """One component image alone."""
    return _blended(spark, sf_dir, component=2)


@_query(f"""{_soft(4)}, n AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY far, k) AS n FROM q),
m AS (SELECT a.y, a.x, a.k AS k1, b.k AS k2, CASE WHEN a.far + b.far > 0 THEN b.far / (a.far + b.far) ELSE 1 END AS t FROM n a JOIN n b ON a.y = b.y AND a.x = b.x AND a.n = 1 AND b.n = 2)
SELECT m.y, m.x, round(t * a.h + (1 - t) * b.h, 6) AS v FROM m JOIN h a ON a.y = m.y AND a.x = m.x AND a.k = k1 JOIN h b ON b.y = m.y AND b.x = m.x AND b.k = k2""")
def linear_interp_k4(spark, sf_dir):
    """Four component images, blended linearly between the two nearest centres."""
    return _blended(spark, sf_dir, variant=Variant.INTERPOLATION)


# ---- components, metrics -------------------------------------------------------------


@_query(f"WITH {_GRID} SELECT round(avg(g0), 4) AS m0, round(avg(g1), 4) AS m1, round(covar_pop(g0, g0), 3) AS c00, round(covar_pop(g0, g1), 3) AS c01, round(covar_pop(g1, g1), 3) AS c11 FROM g")
def pca_covariance(spark, sf_dir):
    """Mean and covariance of the guide from the moments that PCA uses."""
    m = pca.moments(events_grid(spark, sf_dir))
    mean = [F.get("total", i) / F.col("n") for i in range(2)]
    cov = {f"c{i}{j}": F.round(F.get("gram", i * 2 + j) / F.col("n") - mean[i] * mean[j], 3) for i, j in ((0, 0), (0, 1), (1, 1))}
    return m.select(*(F.round(v, 4).alias(f"m{i}") for i, v in enumerate(mean)), *(v.alias(k) for k, v in cov.items()))


@_query(f"WITH {_GRID}, t AS (SELECT g0, g1, CAST(y // (h // 5) AS INTEGER) AS tj, CAST(x // 20 AS INTEGER) AS ti FROM g CROSS JOIN s) SELECT tj, ti, round(sqrt(covar_pop(g0, g0)), 5) AS s0, round(sqrt(covar_pop(g1, g1)), 5) AS s1, round(covar_pop(g0, g1) / sqrt(covar_pop(g0, g0) * covar_pop(g1, g1)), 5) AS r FROM t GROUP BY tj, ti")
def tile_covariance(spark, sf_dir):
    """Covariance of the guide in each of 5 x 5 tiles, as deviations and correlation."""
    rows = with_tiles(events_grid(spark, sf_dir), 0, divisions=(5, 5))
    g = [F.get("g", i) for i in range(2)]
    v = [F.covar_pop(c, c) for c in g]
    return rows.groupBy("tj", "ti").agg(*(F.round(F.sqrt(v[i]), 5).alias(f"s{i}") for i in range(2)), F.round(F.covar_pop(*g) / F.sqrt(v[0] * v[1]), 5).alias("r"))


@_query(f"WITH {_GRID}, m AS (SELECT avg(g0) AS a, avg(g1) AS b, covar_pop(g0, g0) AS p, covar_pop(g0, g1) AS q, covar_pop(g1, g1) AS r FROM g), l AS (SELECT *, (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q) AS l1 FROM m) SELECT round(l1, 3) AS l1, round(p + r - l1, 3) AS l2 FROM l")
def pca_eigenvalues(spark, sf_dir):
    """The eigenvalues of the guide's covariance."""
    return pca.fit(events_grid(spark, sf_dir), 2).select(F.round(F.get("eigenvalues", 0), 3).alias("l1"), F.round(F.get("eigenvalues", 1), 3).alias("l2"))


@_query(f"WITH {_GRID}, {_separable(_gauss())}, er AS (SELECT avg((f0 - v) * (f0 - v)) AS mse FROM g JOIN v2 USING (y, x)) SELECT 0 AS img_id, round(mse, 5) AS mse, round(10 * log10(65025 / mse), 6) AS psnr_db FROM er")
def psnr_blur_vs_src(spark, sf_dir):
    """The smoothed grid against the grid."""
    px = events_grid(spark, sf_dir)
    return psnr(px, gaussian(px, sigma_space=SS, radius=9)).select("img_id", F.round("mse", 5).alias("mse"), F.round("psnr_db", 6).alias("psnr_db"))


@_query(f"WITH {_GRID}, {_separable(_gauss())}, er AS (SELECT avg((f0 - v) * (f0 - v)) AS mse FROM g JOIN v2 USING (y, x) CROSS JOIN s WHERE y BETWEEN 3 AND h - 4 AND x BETWEEN 3 AND 96) SELECT 0 AS img_id, round(mse, 5) AS mse, round(10 * log10(65025 / mse), 6) AS psnr_db FROM er")
def psnr_cropped(spark, sf_dir):
    """The same without three pixels at the edges."""
    px = events_grid(spark, sf_dir)
    return psnr(px, gaussian(px, sigma_space=SS, radius=9), crop=3).select("img_id", F.round("mse", 5).alias("mse"), F.round("psnr_db", 6).alias("psnr_db"))


@_query("SELECT event_type AS method, count(value) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def run_stats(spark, sf_dir):
    """Median, mean, extremes and deviation by group, as for repeated runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("method"), "value")
    out = statistics(e, "value", "method")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "mean", "std")})


@_query("""WITH r AS (SELECT event_type AS method, user_id % 5 AS k, median(value) AS m FROM events GROUP BY ALL), b AS (SELECT k, m FROM r WHERE method = (SELECT min(event_type) FROM events))
SELECT r.method, r.k, round(r.m - b.m, 6) AS gain FROM r JOIN b USING (k)""")
def gain_vs_baseline(spark, sf_dir):
    """Medians less that of a baseline with the same setting."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("k"), "value")
    med = statistics(e, "value", "method", "k")
    base = e.agg(F.min("method")).first()[0]
    at = F.max(F.when(F.col("method") == F.lit(base), F.col("median"))).over(Window.partitionBy("k"))
    return med.withColumn("gain", F.round(F.col("median") - at, 6)).where("gain is not null").select("method", "k", "gain")


def _basis(group: str = "") -> str:
    """SQL of the first component of two channels (v0, v1), by the closed form, for each group."""
    by = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""cm AS (SELECT {by}covar_pop(g0, g0) AS p, covar_pop(g0, g1) AS q, covar_pop(g1, g1) AS r FROM t{tail}),
cl AS (SELECT *, (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q) AS l1 FROM cm),
cu AS (SELECT *, CASE WHEN abs(l1 - r) >= abs(l1 - p) THEN l1 - r ELSE q END AS a, CASE WHEN abs(l1 - r) >= abs(l1 - p) THEN q ELSE l1 - p END AS b FROM cl),
cv AS (SELECT *, (CASE WHEN (CASE WHEN abs(a) >= abs(b) THEN a ELSE b END) < 0 THEN -1 ELSE 1 END) / sqrt(a * a + b * b) AS z FROM cu)"""


@_query(f"WITH {_GRID}, t AS (SELECT * FROM g), {_basis()} SELECT y, x, round(g0 * a * z + g1 * b * z, 5) AS v FROM g CROSS JOIN cv")
def pca_project(spark, sf_dir):
    """The guide's first component over the whole image."""
    return pca.project(events_grid(spark, sf_dir), 1).select("y", "x", F.round(F.get("g", 0), 5).alias("v"))


@_query(f"WITH {_GRID}, t AS (SELECT g.*, CAST(y // (h // 5) AS INTEGER) AS tj, CAST(x // 20 AS INTEGER) AS ti FROM g CROSS JOIN s), {_basis('tj, ti')} SELECT y, x, round(g0 * a * z + g1 * b * z, 5) AS v FROM t JOIN cv USING (tj, ti)")
def pca_project_tiles(spark, sf_dir):
    """The guide's first component in each of 5 x 5 tiles."""
    return pca.project_tiles(events_grid(spark, sf_dir), 1, divisions=(5, 5)).select("y", "x", F.round(F.get("f", 0), 5).alias("v"))


@_query(f"WITH {_GRID}, t AS (SELECT * FROM g), {_basis()} SELECT 0 AS img_id, round(10 * log10(65025 / ((p + r - l1) / 2)), 5) AS psnr_db FROM cv")
def pca_reconstruction_psnr(spark, sf_dir):
    """The guide against its reconstruction from one component: what is lost is the second eigenvalue."""
    return pca.reconstruction_psnr(events_grid(spark, sf_dir), 1).select("img_id", F.round("psnr_db", 5).alias("psnr_db"))


_TILE_PCA = f"""WITH {_GRID}, zt AS (SELECT CAST(a.i AS INTEGER) AS tj, CAST(b.i AS INTEGER) AS ti FROM (SELECT unnest(range(0, 5)) AS i) a, (SELECT unnest(range(0, 5)) AS i) b),
zp AS MATERIALIZED (
  SELECT tj, ti, {_map("(tj * (h // 5) + a.d)", "h", Border.REFLECT101)} AS qy, {_map("(ti * 20 + b.d)", "w", Border.REFLECT101)} AS qx
  FROM zt CROSS JOIN s JOIN (SELECT unnest(range(-8, 300)) AS d) a ON a.d < h // 5 + 8 CROSS JOIN (SELECT unnest(range(-8, 28)) AS d) b
), tb AS (SELECT tj, ti, g0, g1 FROM zp JOIN g ON g.y = qy AND g.x = qx), {_basis("tj, ti").replace("FROM t ", "FROM tb ")}, {_taps(R)},
n AS (SELECT t.*, CAST(y // (h // 5) AS INTEGER) AS tj, CAST(x // 20 AS INTEGER) AS ti FROM t CROSS JOIN s),
m AS (SELECT n.y, n.x, n.f0, exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE - pow(((g0 - p0) * a + (g1 - p1) * b) * z, 2) / {2 * SR * SR}::DOUBLE) AS wt FROM n JOIN cv USING (tj, ti))
SELECT y, x, round(sum(wt * f0) / sum(wt), 5) AS v FROM m GROUP BY y, x"""


@_query(_TILE_PCA)
def hdgf_tile_pca(spark, sf_dir):
    """The exact filter with each tile's guide reduced to its first component."""
    out = exact.hdgf_tile_pca(events_grid(spark, sf_dir), sigma_space=SS, sigma_range=SR, pca_dim=1, radius=R, divisions=(5, 5))
    return out.select("y", "x", F.round(F.get("f", 0), 5).alias("v"))


# ---- sources, signals, sizes ---------------------------------------------------------


def _halves(spark, sf_dir):
    """The grid's even and odd lines as two images of one channel."""
    px = events_grid(spark, sf_dir)
    one = lambda k, c: px.where(F.col("y") % 2 == k).select("img_id", F.floor(F.col("y") / 2).cast("int").alias("y"), "x", F.slice("g", c, 1).alias("f"))
    return one(0, 1), one(1, 2)


@_query(f"WITH {_GRID} SELECT CAST(a.y // 2 AS INTEGER) AS y, a.x, round(a.g0, 6) AS f0, round(a.g0, 6) AS c0, round(b.g1 * 0.5::DOUBLE, 6) AS c1 FROM g a JOIN g b ON b.y = a.y + 1 AND b.x = a.x WHERE a.y % 2 = 0")
def pair_images(spark, sf_dir):
    """One image guided by itself and another, scaled by a half."""
    a, b = _halves(spark, sf_dir)
    out = channels.guided(a, b, Signal.RGBIR, 0.5)
    return out.select("y", "x", F.round(F.get("f", 0), 6).alias("f0"), *(F.round(F.get("g", i), 6).alias(f"c{i}") for i in range(2)))


@_query(f"WITH {_GRID} SELECT CAST(a.y // 2 AS INTEGER) AS y, a.x, round(b.g1, 6) AS f0, round(a.g0, 6) AS c0, round(b.g1 * 0.5::DOUBLE, 6) AS c1 FROM g a JOIN g b ON b.y = a.y + 1 AND b.x = a.x WHERE a.y % 2 = 0")
def signal_depth(spark, sf_dir):
    """The second image filtered, guided by both."""
    a, b = _halves(spark, sf_dir)
    out = channels.guided(a, b, Signal.RGBD, 0.5)
    return out.select("y", "x", F.round(F.get("f", 0), 6).alias("f0"), *(F.round(F.get("g", i), 6).alias(f"c{i}") for i in range(2)))


@_query(f"WITH {_GRID} SELECT CAST(a.y // 2 AS INTEGER) AS y, a.x, round(a.g0, 6) AS f0, round(b.g1, 6) AS c0, round(a.g0 * 0.5::DOUBLE, 6) AS c1 FROM g a JOIN g b ON b.y = a.y + 1 AND b.x = a.x WHERE a.y % 2 = 0")
def signal_flash(spark, sf_dir):
    """The first image filtered, guided by the second and itself."""
    a, b = _halves(spark, sf_dir)
    out = channels.guided(a, b, Signal.FNF, 0.5)
    return out.select("y", "x", F.round(F.get("f", 0), 6).alias("f0"), *(F.round(F.get("g", i), 6).alias(f"c{i}") for i in range(2)))


@_query(f"WITH {_GRID}, b AS (SELECT x // 20 AS band, y, x % 20 AS x, f0 FROM g) SELECT y, CAST(x AS INTEGER) AS x, {', '.join(f'round(max(f0) FILTER (band = {i}), 6) AS c{i}' for i in range(5))} FROM b GROUP BY y, x")
def stack_bands(spark, sf_dir):
    """Five upright strips of the grid, images of one channel, as one image of five."""
    px = events_grid(spark, sf_dir).withColumns({"band": F.floor(F.col("x") / 20), "x": F.col("x") % 20})
    return stacked(px, F.col("band")).select("y", "x", *(F.round(F.get("f", i), 6).alias(f"c{i}") for i in range(5)))


@_query(f"""WITH {_GRID}, zm AS MATERIALIZED (SELECT g.y, g.x, 2 + {_map("(g.y - 2)", "(h - 4)", Border.REFLECT101)} AS qy, 2 + {_map("(g.x - 2)", "(w - 4)", Border.REFLECT101)} AS qx FROM g CROSS JOIN s)
SELECT zm.y, zm.x, round(q.f0, 6) AS v FROM zm JOIN g q ON q.y = qy AND q.x = qx""")
def frame_anew(spark, sf_dir):
    """The image without two pixels at the edges, which are then made by reflection."""
    return _value(framed(events_grid(spark, sf_dir), 2, (_height(spark, sf_dir), 100)))


@_query("SELECT CAST(event_id AS INTEGER) AS n, CAST(event_id // 32 * 32 AS INTEGER) AS low, CAST((event_id + 7) // 8 * 8 AS INTEGER) AS high FROM events")
def round_sizes(spark, sf_dir):
    """Sizes rounded down to multiples of 32 and up to multiples of 8."""
    n = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(n.cast("int").alias("n"), channels.floor_to(n, 32).cast("int").alias("low"), channels.ceil_to(n, 8).cast("int").alias("high"))


@_query(f"WITH {_GRID} SELECT y, x, round(f0, 6) AS c0, round(f0, 6) AS c1, round(f0, 6) AS c2 FROM g")
def gray_to_color(spark, sf_dir):
    """One channel in three."""
    out = channels.replicate(F.get("f", 0))
    return events_grid(spark, sf_dir).select("y", "x", *(F.round(F.get(out, i), 6).alias(f"c{i}") for i in range(3)))


@_query(f"WITH {_GRID} SELECT y, x, round(f0, 6) AS v FROM g")
def method_copy(spark, sf_dir):
    """The method that filters nothing."""
    return _value(run_method(-1, events_grid(spark, sf_dir), _SPEC))


@_query("SELECT CAST(p_partkey // 20 AS INTEGER) AS y, CAST(p_partkey % 20 AS INTEGER) AS x, CAST(p_size AS DOUBLE) AS c0, round(p_retailprice, 6) AS c1 FROM part")
def table_as_grid(spark, sf_dir):
    """Another table as an image of two channels."""
    return part_grid(spark, sf_dir).select("y", "x", F.get("f", 0).alias("c0"), F.round(F.get("f", 1), 6).alias("c1"))


# ---- what SQL cannot express ---------------------------------------------------------

_SPEC = FilterSpec(sigma_space=SS, sigma_range=SR, divisions=(5, 5), k=8, iterations=5)


def _free(name: str, run):
    _query(None, name)(run)


for _variant in (Variant.NYSTROM, Variant.SOFT, Variant.INTERPOLATION):
    _free(f"cluster_{_variant}", lambda s, d, v=_variant: _value(cluster_filter(events_grid(s, d), _SPEC.but(variant=v))))

def _tile_centres(s, d, method: Cluster) -> DataFrame:
    """Centres of each of 1 x 5 tiles from every second pixel of every second line, and the pixels nearest to each."""
    out = tile_centres(events_grid(s, d), _SPEC.but(cluster=method, sampler=Sampler.NEAREST, divisions=(1, 5)))
    return out.select("tj", "ti", "k", *(F.round(F.get("mu", i), 6).alias(f"m{i}") for i in range(2)), "weight")


def _table_centres(s, d, method: Cluster) -> DataFrame:
    """Four centres of the whole image."""
    mu = cluster.fit(events_grid(s, d), method, 4, 3)
    return s.createDataFrame([(k, *m) for k, m in enumerate(mu)], "k int, m0 double, m1 double").select("k", F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))


_SAMPLED = f"WITH {_GRID}, p AS MATERIALIZED (SELECT x // 20 AS t, y * 100 + x AS id, 0 AS u, g0 AS a, g1 AS b FROM g WHERE y % 2 = 0 AND x % 2 = 0)"
_COUNTED = """, z AS (SELECT x // 20 AS t, y * 100 + x AS id, g0 AS a, g1 AS b FROM g), zn AS ({near})
SELECT 0 AS tj, CAST(c.t AS INTEGER) AS ti, CAST(c.k AS INTEGER) AS k, round(any_value(m0), 6) AS m0, round(any_value(m1), 6) AS m1, CAST(count(zn.id) AS DOUBLE) AS weight
FROM c LEFT JOIN zn ON zn.t = c.t AND zn.k = c.k GROUP BY c.t, c.k""".format(near=sql_clusters._near("c", "z"))
_TILE_CENTRES = {
    Cluster.MEDIANCUT_MEDIAN: sql_clusters.cut(8, True),
    Cluster.QUANTIZE_WAN: sql_clusters.cut(8, False),
    Cluster.KMEANS_MEDIANCUT: f"{sql_clusters.cut(8, True, 'm')}, {sql_clusters.lloyd('m', 5)}",
    Cluster.KMEANS_WAN: f"{sql_clusters.cut(8, False, 'm')}, {sql_clusters.lloyd('m', 5)}",
    Cluster.QUANTIZE_DIV: sql_clusters.cells(8, 3, most=8),
}
for _c in Cluster:
    _steps = _TILE_CENTRES.get(_c)
    _query(f"{_SAMPLED}, {_steps}{_COUNTED}" if _steps else None, f"centres_{_c}")(lambda s, d, c=_c: _tile_centres(s, d, c))

_DRAWS = [sql_clusters.uniform("0", "id // 100", "id % 100", str(7919 * i)) for i in range(1, 4)]
_POINTS = f"WITH {_GRID}, p AS MATERIALIZED (SELECT 0 AS t, y * 100 + x AS id, {sql_clusters.uniform('0', 'y', 'x', '0')} AS u, g0 AS a, g1 AS b FROM g)"
_SEEDS = sql_clusters.plus_plus(4, 3, _DRAWS, "m")
_TABLE_CENTRES = {
    Cluster.RANDOM_SAMPLE: sql_clusters.by_hash(4),
    Cluster.KMEANS: f"{sql_clusters.by_hash(4, 'm')}, {sql_clusters.lloyd('m', 3)}",
    Cluster.KMEANS_PP: f"{_SEEDS}, {sql_clusters.lloyd('m', 3)}",
    Cluster.KMEANS_PP_FAST: f"{_SEEDS}, {sql_clusters.lloyd('m', 3)}",
    Cluster.GAUSS_INV_MEANS_PP: f"{_SEEDS}, {sql_clusters.lloyd('m', 3, 25.0)}",
    Cluster.KMEANS_MEDIANCUT: f"{sql_clusters.cut(4, True, 'm')}, {sql_clusters.lloyd('m', 3)}",
    Cluster.KMEANS_WAN: f"{sql_clusters.cut(4, False, 'm')}, {sql_clusters.lloyd('m', 3)}",
    Cluster.MEDIANCUT_MEDIAN: sql_clusters.cut(4, True),
    Cluster.QUANTIZE_WAN: sql_clusters.cut(4, False),
    Cluster.QUANTIZE_DIV: sql_clusters.cells(4, 2, stretch=1e-9, same=True),
}
for _c, _steps in _TABLE_CENTRES.items():
    _sql = f"{_POINTS}, {_steps} SELECT CAST(k AS INTEGER) AS k, round(m0, 6) AS m0, round(m1, 6) AS m1 FROM c"
    _query(_sql, f"table_{_c}")(lambda s, d, c=_c: _table_centres(s, d, c))


# ---- approximations against the exact filter -----------------------------------------


def _scene(spark, sf_dir) -> DataFrame:
    """The grid guided by its own two channels, smoothed: edges that a filter can follow."""
    px = events_grid(spark, sf_dir)
    at = ["img_id", "y", "x"]
    a = gaussian(px, sigma_space=4.0, radius=12).select(*at, F.col("f").alias("_a"))
    b = gaussian(px.withColumn("f", F.slice("g", 2, 1)), sigma_space=4.0, radius=12).select(*at, F.col("f").alias("_b"))
    return px.drop("g").join(a, at).join(b, at).select(*at, "f", F.concat("_a", "_b").alias("g"))


def _reached(exact_px: DataFrame, px: DataFrame, floor: float) -> DataFrame:
    """Whether the image comes within `floor` decibels of the exact one, whose mean is given too."""
    mean = exact_px.groupBy("img_id").agg(F.round(F.avg(F.get("f", 0)), 5).alias("exact_mean"))
    near = psnr(exact_px, px).select("img_id", F.lit(floor).alias("floor_db"), (F.col("psnr_db") >= floor).alias("reached"))
    return near.join(mean, "img_id").select("floor_db", "reached", "exact_mean")


def _method_spec(nlm: bool, bands: int = 2) -> FilterSpec:
    return _SPEC.but(sigma_range=18.0 if nlm else 6.0, pca_dim=3 if nlm or bands > 2 else 1)


def _scene_sql(patch: int = 0) -> str:
    """The exact filter's mean over the scene: sigmas 3 and 6 (18 over patches), radius 9."""
    smooth = lambda v, n: _separable("", 12, v).lstrip(", ").replace("m1", f"{n}m1").replace("v1", f"{n}v1").replace("m2", f"{n}m2").replace("v2", f"{n}v2")
    sr = 18.0 if patch else 6.0
    sc = f"""{_gauss(12, 4.0)}, {smooth("f0", "s")}, {smooth("g1", "t")},
sc AS MATERIALIZED (SELECT g.y, g.x, g.f0, a.v AS a, b.v AS b FROM g JOIN sv2 a ON a.y = g.y AND a.x = g.x JOIN tv2 b ON b.y = g.y AND b.x = g.x)"""
    values = "list_value(a, b)"
    if patch:
        sc += f""", pm AS MATERIALIZED (
  SELECT p.y, p.x, (i.d + 1) * 3 + j.d + 1 AS pos, {_map("p.y + i.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + j.d", "s.w", Border.REFLECT101)} AS qx
  FROM g p CROSS JOIN s CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) i CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) j
), pv AS MATERIALIZED (SELECT pm.y, pm.x, flatten(list(list_value(q.a, q.b) ORDER BY pos)) AS g FROM pm JOIN sc q ON q.y = qy AND q.x = qx GROUP BY pm.y, pm.x)"""
        base = "(SELECT sc.y, sc.x, sc.f0, pv.g FROM sc JOIN pv USING (y, x))"
    else:
        base = f"(SELECT y, x, f0, {values} AS g FROM sc)"
    return f"""WITH {_GRID}, {sc}, px AS MATERIALIZED {base}, tm AS MATERIALIZED (
  SELECT p.y, p.x, i.d AS dy, j.d AS dx, {_map("p.y + i.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + j.d", "s.w", Border.REFLECT101)} AS qx
  FROM g p CROSS JOIN s CROSS JOIN (SELECT unnest(range(-9, 10)) AS d) i CROSS JOIN (SELECT unnest(range(-9, 10)) AS d) j
), tw AS (
  SELECT tm.y, tm.x, q.f0, exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE - pow(list_distance(p.g, q.g), 2) / {2 * sr * sr}::DOUBLE) AS wt
  FROM tm JOIN px p ON p.y = tm.y AND p.x = tm.x JOIN px q ON q.y = tm.qy AND q.x = tm.qx
), ex AS (SELECT y, x, sum(wt * f0) / sum(wt) AS v FROM tw GROUP BY y, x)
SELECT {{floor}}::DOUBLE AS floor_db, TRUE AS reached, round(avg(v), 5) AS exact_mean FROM ex"""


#: Decibels that each method reaches at least, whose settings are _method_spec(): without patches, over patches.
_FLOORS = {0: (60.0, 60.0), 1: (55.0, 60.0), 2: (55.0, 60.0), 3: (48.0, 44.0), 4: (48.0, 48.0), 5: (48.0, 48.0), 6: (52.0, 52.0), 7: (52.0, 52.0), 8: (52.0, 52.0)}


def _method_reaches(spark, sf_dir, code: int, nlm: bool) -> DataFrame:
    """A method against the exact filter with the full guide."""
    px, spec = _scene(spark, sf_dir), _method_spec(nlm)
    return _reached(run_cell(0, 0, int(nlm), px, spec), run_method(code, px, spec, nlm), _FLOORS[code][nlm])


def _cells_reach(spark, sf_dir, filter_kind: int) -> DataFrame:
    """The command line's cells of one filter: three reductions, without and over patches."""
    px, out = _scene(spark, sf_dir), None
    for patch in (0, 1):
        spec = _method_spec(bool(patch))
        exact_px = run_cell(0, 0, patch, px, spec)
        for reduction in range(3):
            floor = _FLOORS[3 * (filter_kind - 1) + reduction][patch]
            one = _reached(exact_px, run_cell(filter_kind, reduction, patch, px, spec), floor).select(F.lit(reduction).alias("reduction"), F.lit(patch).alias("patch"), "*")
            out = one if out is None else out.unionByName(one)
    return out


for _code, _floor in _FLOORS.items():
    for _nlm in (False, True):
        _sql = _scene_sql(int(_nlm)).format(floor=_floor[_nlm])
        _query(_sql, f"method_{_code}{'_nlm' * _nlm}")(lambda s, d, c=_code, n=_nlm: _method_reaches(s, d, c, n))
for _kind, _name in ((1, "clusters"), (2, "lattice"), (3, "kd_tree")):
    _parts = [f"SELECT {r} AS reduction, {p} AS patch, * FROM ({_scene_sql(p).format(floor=_FLOORS[3 * (_kind - 1) + r][p])})" for p in (0, 1) for r in range(3)]
    _query(" UNION ALL ".join(_parts), f"cells_{_name}")(lambda s, d, k=_kind: _cells_reach(s, d, k))


def _bands(px: DataFrame) -> DataFrame:
    """33 bands from the guide's two channels, filtered and guided by themselves but for the signal's first."""
    mixed = F.array(*(F.get("g", 0) * F.lit(math.cos(i / 7)) + F.get("g", 1) * F.lit(math.sin(i / 5)) for i in range(33)))
    return px.withColumn("g", mixed)


_HSI = _scene_sql().replace("list_value(a, b)", "list_value(" + ", ".join(f"a * {math.cos(i / 7)!r}::DOUBLE + b * {math.sin(i / 5)!r}::DOUBLE" for i in range(33)) + ")").replace(f"{2 * 6.0 * 6.0}::DOUBLE", f"{2 * 24.0 * 24.0}::DOUBLE")


@_query(_HSI.format(floor=55.0))
def hsi_planar(spark, sf_dir):
    """Clusters over 33 bands reduced to three components in each tile, against the exact filter over all 33."""
    px, spec = _bands(_scene(spark, sf_dir)), _SPEC.but(sigma_range=24.0, pca_dim=min(3, 33))
    return _reached(run_cell(0, 0, 0, px, spec), run_method(2, px, spec), 55.0)


@_query(f"""{_PATCH.replace("q.f0 AS v)", "q.g0 AS v, q.g1 AS w)").replace("q.f0 AS v", "q.g0 AS v, q.g1 AS w")}, u AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS d), t AS MATERIALIZED (
  SELECT p.y, p.x, a.d AS dy, c.d AS dx, {_map("p.y + a.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + c.d", "s.w", Border.REFLECT101)} AS qx FROM g p CROSS JOIN s CROSS JOIN u a CROSS JOIN u c
), d AS (
  SELECT t.y, t.x, t.dy, t.dx, qy, qx, sum((m.v - n.v) * (m.v - n.v) + (m.w - n.w) * (m.w - n.w)) AS d FROM t JOIN b m ON m.y = t.y AND m.x = t.x JOIN b n ON n.y = qy AND n.x = qx AND n.pos = m.pos GROUP BY ALL
), w AS (SELECT d.y, d.x, exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE - d / {2 * SR * SR}::DOUBLE) AS wt, g.f0 FROM d JOIN g ON g.y = qy AND g.x = qx)
SELECT y, x, round(sum(wt * f0) / sum(wt), 6) AS v FROM w GROUP BY y, x""")
def cell_exact_nlm(spark, sf_dir):
    """The command line's exact cell over patches of both guide channels."""
    return _value(run_cell(0, 0, 1, events_grid(spark, sf_dir), _SPEC.but(radius=2)))


_NYSTROM_MU = [[10.0, 20.0], [40.0, 60.0], [120.0, 50.0]]


@_query(f"""WITH {_GRID}, c(k, m0, m1) AS (VALUES {", ".join(f"({k}, {m[0]}::DOUBLE, {m[1]}::DOUBLE)" for k, m in enumerate(_NYSTROM_MU))}),
q AS MATERIALIZED (SELECT g.y, g.x, g.f0, c.k, exp(-((g0 - m0) * (g0 - m0) + (g1 - m1) * (g1 - m1)) / {2 * SR * SR}::DOUBLE) AS c FROM g CROSS JOIN c),
w AS MATERIALIZED (SELECT p.y, p.x, a.d AS dy, b.d AS dx, {_map("p.y + a.d", "s.h", Border.REFLECT101)} AS qy, {_map("p.x + b.d", "s.w", Border.REFLECT101)} AS qx FROM g p CROSS JOIN s CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) a CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) b),
h AS MATERIALIZED (SELECT w.y, w.x, q.k, sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE) * c * f0) / sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE)) AS top,
  sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE) * c) / sum(exp(-CAST(dy * dy + dx * dx AS DOUBLE) / {2 * SS * SS}::DOUBLE)) AS low FROM w JOIN q ON q.y = qy AND q.x = qx GROUP BY w.y, w.x, q.k),
k AS (SELECT exp(-((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1)) / {2 * SR * SR}::DOUBLE) AS v, a.k AS i, b.k AS j FROM c a CROSS JOIN c b),
b AS (SELECT max(v) FILTER (i = 0 AND j = 1) AS b01, max(v) FILTER (i = 0 AND j = 2) AS b02, max(v) FILTER (i = 1 AND j = 2) AS b12 FROM k),
v AS (SELECT *, 1 + 2 * b01 * b02 * b12 - b01 * b01 - b02 * b02 - b12 * b12 AS det FROM b),
n(i, j, v) AS (SELECT 0, 0, (1 - b12 * b12) / det FROM v UNION ALL SELECT 1, 1, (1 - b02 * b02) / det FROM v UNION ALL SELECT 2, 2, (1 - b01 * b01) / det FROM v
  UNION ALL SELECT 0, 1, (b02 * b12 - b01) / det FROM v UNION ALL SELECT 1, 0, (b02 * b12 - b01) / det FROM v UNION ALL SELECT 0, 2, (b01 * b12 - b02) / det FROM v
  UNION ALL SELECT 2, 0, (b01 * b12 - b02) / det FROM v UNION ALL SELECT 1, 2, (b01 * b02 - b12) / det FROM v UNION ALL SELECT 2, 1, (b01 * b02 - b12) / det FROM v),
o AS (SELECT q.y, q.x, any_value(q.f0) AS f0, sum(q.c * n.v * h.top) AS top, sum(q.c * n.v * h.low) AS low FROM q JOIN n ON n.i = q.k JOIN h ON h.y = q.y AND h.x = q.x AND h.k = n.j GROUP BY q.y, q.x)
SELECT y, x, round(top / low, 2) + 0.0::DOUBLE AS v FROM o WHERE abs(low) > 0.05""")
def nystrom_k3(spark, sf_dir):
    """Nystrom with three given centres; the kernel between centres has a closed inverse. Where the denominator is not small."""
    import numpy as np

    from prismgrid.functions import kernels, lowrank
    from prismgrid.functions.clustering import distances
    from prismgrid.operators.tiling import apply_tiles

    mu = np.array(_NYSTROM_MU)
    spec = FilterSpec(sigma_space=SS, sigma_range=SR, radius=R, variant=Variant.NYSTROM, smoother=Smoother.FIR)

    def both(b):
        f, g = b.image("f"), b.image("g")
        c = np.exp(-distances(g.reshape(-1, 2), mu) / (2 * SR**2)).reshape(*g.shape[:2], 3)
        own = c[R:-R, R:-R] @ np.linalg.inv(np.exp(-distances(mu, mu) / (2 * SR**2)))
        low = (own * kernels.smooth(c, SS, R)).sum(2, keepdims=True)
        return np.concatenate([lowrank.filtered(f, g, mu, spec, R), low], axis=2)

    out = apply_tiles(events_grid(spark, sf_dir), both, R, divisions=(5, 5))
    return out.where(F.abs(F.get("f", 1)) > 0.05).select("y", "x", (F.round(F.get("f", 0), 2) + 0.0).alias("v"))


@_query(f"WITH {_GRID}, {_centres(5)} SELECT round(CAST(count(DISTINCT a.k) AS DOUBLE), 6) AS total, round(sum(pow(exp(-((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1)) / {2 * SR * SR}::DOUBLE), 2)), 6) AS squares FROM c a CROSS JOIN c b")
def kernel_eigenvalue_sums(spark, sf_dir):
    """The eigenvalues of the kernel between five given centres, by their sum and the sum of their squares."""
    mu = [(0, 0, 0, k, m, 1.0) for k, m in enumerate(_first(events_grid(spark, sf_dir), 5))]
    centres = spark.createDataFrame(mu, "img_id int, tj int, ti int, k int, mu array<double>, weight double")
    return kernel_eigenvalues(centres, SR).agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"))


_free("sample_dither_gradient", lambda s, d: _value(sampling.dither(events_grid(s, d), 0.25, divisions=(5, 5))))
_free("sample_dither_dog", lambda s, d: _value(sampling.dither(events_grid(s, d), 0.25, by_dog=True, sigma=1.0, divisions=(5, 5))))


@_query(f"{_GRADIENT}, m AS (SELECT avg(e) AS m FROM e) SELECT y, x, round(f0, 6) AS v FROM e CROSS JOIN m WHERE {sql_clusters.uniform('0', 'y', 'x', '0')} <= e * 0.25::DOUBLE / m")
def sample_importance(spark, sf_dir):
    """Pixels kept with a chance in proportion to their gradient, a quarter on the whole."""
    return _value(sampling.importance(events_grid(spark, sf_dir), 0.25))


_KEYS = {-1: -0.09375, 0: 0.59375, 1: 0.59375, 2: -0.09375}  # the Keys kernel (a = -0.75) half way between points


@_query(f"""WITH {_GRID}, k(d, wt) AS (VALUES {", ".join(f"({d}, {w}::DOUBLE)" for d, w in _KEYS.items())}),
o AS (SELECT DISTINCT y // 2 AS oy, x // 2 AS ox FROM g),
m AS MATERIALIZED (
  SELECT oy, ox, a.wt * b.wt AS wt, oy * 2 // (h // 5) AS tj, ox * 2 // 20 AS ti, oy * 2 % (h // 5) + a.d AS ly, ox * 2 % 20 + b.d AS lx, h // 5 AS th
  FROM o CROSS JOIN s CROSS JOIN k a CROSS JOIN k b
), q AS (SELECT oy, ox, wt, tj * th + {_map("ly", "th", Border.REFLECT101)} AS qy, ti * 20 + {_map("lx", "20", Border.REFLECT101)} AS qx FROM m)
SELECT CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(sum(wt * g.f0) + 1e-9::DOUBLE, 6) AS v FROM q JOIN g ON g.y = qy AND g.x = qx GROUP BY oy, ox""")
def sample_cubic(spark, sf_dir):
    """Half the resolution by the Keys kernel, in 5 x 5 tiles that end by reflection. The sums often end in a half: they are moved off it."""
    out = sampling.cubic(events_grid(spark, sf_dir), 0.25, divisions=(5, 5))
    return out.select("y", "x", F.round(F.get("f", 0) + 1e-9, 6).alias("v"))


@_query(f"WITH {_GRID} SELECT y, x, round(f0 + 15.0::DOUBLE * sqrt(-2 * ln({sql_clusters.uniform('0', 'y', 'x', '0', '0')})) * cos(6.283185307179586::DOUBLE * {sql_clusters.uniform('0', 'y', 'x', '0', '1')}), 6) AS v FROM g")
def add_noise(spark, sf_dir):
    """Gaussian noise that a hash of the place decides."""
    return _value(channels.add_noise(events_grid(spark, sf_dir), 15.0))




def _patch_pca(group: str) -> str:
    """SQL of the first component of 18-channel patches, by squaring the covariance until one direction is left."""
    steps = ["m0 AS MATERIALIZED (SELECT a.t, a.i, b.i AS j, covar_pop(a.v, b.v) AS v FROM r a JOIN r b USING (t, y, x) GROUP BY a.t, a.i, b.i)"]
    for n in range(22):
        steps.append(f"x{n} AS MATERIALIZED (SELECT a.t, a.i, b.j, sum(a.v * b.v) AS v FROM m{n} a JOIN m{n} b ON a.t = b.t AND a.j = b.i GROUP BY a.t, a.i, b.j)")
        steps.append(f"m{n + 1} AS MATERIALIZED (SELECT t, i, j, v / (sum(v) FILTER (i = j) OVER (PARTITION BY t)) AS v FROM x{n})")
    patch = _PATCH.replace("q.f0 AS v", "q.g0 AS v, q.g1 AS w")
    return f"""{patch}, r AS MATERIALIZED (
  SELECT {group} AS t, y, x, pos * 2 AS i, b.v FROM b CROSS JOIN s UNION ALL SELECT {group}, y, x, pos * 2 + 1, b.w FROM b CROSS JOIN s
), {", ".join(steps)}, c AS (SELECT t, i AS c, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC) AS nth FROM m22 WHERE i = j) WHERE nth = 1),
u AS (SELECT m.t, m.i, m.v / sqrt(c.v) AS u FROM m22 m JOIN c ON c.t = m.t AND c.c = m.j)
SELECT y, x, round(sum(r.v * u.u), 2) + 0.0::DOUBLE AS v FROM r JOIN u USING (t, i) GROUP BY y, x"""


@_query(_patch_pca("0"))
def patch_pca(spark, sf_dir):
    """The first component of the guide's 3 x 3 patches over the whole image."""
    return pca.patch_pca(events_grid(spark, sf_dir), 1, 3).select("y", "x", (F.round(F.get("g", 0), 2) + 0.0).alias("v"))


@_query(_patch_pca("y // (h // 5) * 5 + x // 20"))
def patch_pca_tiles(spark, sf_dir):
    """The same in each of 5 x 5 tiles."""
    return pca.patch_pca_tiles(events_grid(spark, sf_dir), 1, 3, divisions=(5, 5)).select("y", "x", (F.round(F.get("f", 0), 2) + 0.0).alias("v"))


_free("lattice", lambda s, d: _value(lattice_filter(events_grid(s, d), _SPEC)))
_free("lattice_tile_pca", lambda s, d: _value(lattice_filter(events_grid(s, d), _SPEC, pca_dim=1)))
_free("kd_tree", lambda s, d: _value(kd_tree_filter(events_grid(s, d), _SPEC.but(sigma_space=2.0))))
_free("kd_tree_tile_pca", lambda s, d: _value(kd_tree_filter(events_grid(s, d), _SPEC.but(sigma_space=2.0), pca_dim=1)))
_free("nlm_tile_pca", lambda s, d: _value(cluster_filter(events_grid(s, d), _SPEC, pca_dim=3, patch=1)))
_free("kernel_eigenvalues", lambda s, d: kernel_eigenvalues(tile_centres(events_grid(s, d), _SPEC), SR))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
