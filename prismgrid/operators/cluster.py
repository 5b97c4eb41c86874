"""Cluster centres of whole tables of guide vectors, by passes of plain aggregates.

Centres are few (a parameter) and live on the driver; pixels never do. For centres of each
tile see approximate.tile_centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.model import Cluster
from prismgrid.operators.channels import hashed_uniform

Centres = list[list[float]]


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _literal(mu: Centres) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in mu))


def nearest(column: Column, mu: Centres) -> Column:
    """(d, k): squared distance and index of the nearest centre, the first of equals."""
    return F.array_min(F.transform(_literal(mu), lambda c, k: F.struct(squared(column, c).alias("d"), k.alias("k"))))


def assign(px: DataFrame, mu: Centres, column: str = "g") -> DataFrame:
    """px with k, the nearest centre, and d, its squared distance."""
    return px.withColumn("_n", nearest(F.col(column), mu)).withColumns({"k": F.col("_n.k"), "d": F.col("_n.d")}).drop("_n")


def step(px: DataFrame, mu: Centres, column: str = "g", sigma: float | None = None) -> DataFrame:
    """k, weight, mu: the weighted means of the pixels nearest to each centre.

    sigma: a pixel weighs 1 - exp(-d^2 / 2 sigma^2), so that those near a centre already
    pull less; else 1. Centres without weight are missing.
    """
    rows = assign(px, mu, column)
    w = F.lit(1.0) if sigma is None else 1 - F.exp(-F.col("d") / F.lit(2.0 * sigma * sigma))
    dims = len(mu[0])
    sums = rows.withColumn("_w", w).groupBy("k").agg(F.sum("_w").alias("weight"), *(F.sum(F.get(column, c) * F.col("_w")).alias(f"_s{c}") for c in range(dims)))
    return sums.where("weight > 1e-12").select("k", "weight", F.array(*(F.col(f"_s{c}") / F.col("weight") for c in range(dims))).alias("mu"))


def lloyd(px: DataFrame, mu: Centres, iterations: int = 10, column: str = "g", sigma: float | None = None) -> Centres:
    """Steps until the centres stay; one without pixels stays where it is."""
    for _ in range(iterations):
        new = {r.k: list(r.mu) for r in step(px, mu, column, sigma).collect()}
        out = [new.get(k, c) for k, c in enumerate(mu)]
        if all(abs(a - b) < 1e-9 for x, y in zip(out, mu, strict=True) for a, b in zip(x, y, strict=True)):
            return out
        mu = out
    return mu


def cost(px: DataFrame, mu: Centres, column: str = "g") -> float:
    """Sum of squared distances to the nearest centres."""
    return px.agg(F.sum(nearest(F.col(column), mu)["d"])).first()[0]


def _uniform(seed: int) -> Column:
    return hashed_uniform(F.col("img_id"), F.col("y"), F.col("x"), F.lit(seed))


def random_sample(px: DataFrame, k: int, seed: int = 0, column: str = "g") -> Centres:
    """k pixels by the order of a hash."""
    return [list(r[0]) for r in px.orderBy(_uniform(seed), "img_id", "y", "x").select(column).limit(k).collect()]


def plus_plus(px: DataFrame, k: int, seed: int = 0, trials: int = 3, column: str = "g") -> Centres:
    """k-means++: each centre is drawn with a chance in proportion to the squared distance to those before.

    The draw is an exponential race: the least -log(u) / d^2 of all pixels wins, so a pass
    is a top-k; of `trials` candidates the one that lowers the cost most is taken.
    """
    mu = random_sample(px, 1, seed, column)
    while len(mu) < k:
        race = -F.log(_uniform(seed + 7919 * len(mu))) / nearest(F.col(column), mu)["d"]
        far = px.where(nearest(F.col(column), mu)["d"] > 0)
        found = [list(r[0]) for r in far.orderBy(race, "img_id", "y", "x").select(column).limit(max(1, trials)).collect()]
        if not found:
            break
        if len(found) > 1:
            left = px.agg(*(F.sum(nearest(F.col(column), [*mu, c])["d"]).alias(f"c{i}") for i, c in enumerate(found))).first()
            found = [found[min(range(len(found)), key=lambda i: left[i])]]
        mu.append(found[0])
    return mu


def uniform_cells(px: DataFrame, size: float, k: int, column: str = "g", dims: int = 2, origin: list[float] | None = None) -> DataFrame:
    """cell (its index along each channel as one string), n, mu: the k fullest cells of a grid of this size."""
    at = origin or [0.0] * dims
    cell = F.concat_ws(",", *(F.floor((F.get(column, c) - F.lit(float(at[c]))) / F.lit(float(size))).cast("long").cast("string") for c in range(dims)))
    sums = px.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *(F.avg(F.get(column, c)).alias(f"_m{c}") for c in range(dims)))
    return sums.orderBy(F.desc("n"), "cell").limit(k).select("cell", "n", F.array(*(F.col(f"_m{c}") for c in range(dims))).alias("mu"))


def _box(bounds: list[tuple[int, float, bool]], column: str) -> Column:
    out = F.lit(True)
    for c, at, low in bounds:
        v = F.get(column, c)
        out = out & ((v <= at) if low else (v > at))
    return out


def cut_boxes(px: DataFrame, k: int, by_median: bool = True, column: str = "g", dims: int = 2) -> list[list[tuple[int, float, bool]]]:
    """Boxes as lists of (channel, value, whether below): the widest split at its median, or that of most variance at its mean."""
    boxes: list[list[tuple[int, float, bool]]] = [[]]

    def about(box):
        v = [F.get(column, c) for c in range(dims)]
        aggs = [F.count("*")]
        for c in v:
            aggs += [F.max(c) - F.min(c), F.median(c)] if by_median else [F.coalesce(F.var_pop(c), F.lit(0.0)), F.avg(c)]
        return list(px.where(_box(box, column)).agg(*aggs).first())

    facts = [about([])]
    while len(boxes) < k:
        spread = [max(f[1::2], default=0) if by_median else sum(f[1::2]) * f[0] for f in facts]
        i = max(range(len(boxes)), key=lambda j: (spread[j] or 0, -j))
        if not spread[i]:
            break
        c = max(range(dims), key=lambda j: (facts[i][1 + 2 * j], -j))
        at = float(facts[i][2 + 2 * c])
        parts = [[*boxes[i], (c, at, True)], [*boxes[i], (c, at, False)]]
        found = [about(p) for p in parts]
        if not found[1][0]:  # nothing above the median: it is the largest value
            facts[i] = [facts[i][0], *[0 if j % 2 == 0 else x for j, x in enumerate(facts[i][1:])]]
            continue
        boxes[i : i + 1], facts[i : i + 1] = parts, found
    return boxes


def box_centres(px: DataFrame, boxes, by_median: bool = True, column: str = "g", dims: int = 2) -> Centres:
    """The medians (or means) of each box's channels."""
    mid = F.median if by_median else F.avg
    rows = [px.where(_box(b, column)).agg(*(mid(F.get(column, c)) for c in range(dims))).first() for b in boxes]
    return [[float(v) for v in r] for r in rows if r[0] is not None]


def fit(px: DataFrame, method: Cluster, k: int, iterations: int = 10, seed: int = 0, trials: int = 3, sigma: float = 25.0, column: str = "g", dims: int = 2) -> Centres:
    """Centres of all pixels by a method. Each pass reads the pixels once; persist them first."""
    if method == Cluster.RANDOM_SAMPLE:
        return random_sample(px, k, seed, column)
    if method == Cluster.QUANTIZE_DIV:
        edge = px.agg(*(f(F.get(column, c)) for f in (F.min, F.max) for c in range(dims))).first()
        low = [v or 0.0 for v in edge[:dims]]
        span = max((b or 0.0) - a for a, b in zip(low, edge[dims:], strict=True)) * (1 + 1e-9) or 1.0
        per = 1
        while per**dims < k:
            per += 1
        return [list(r.mu) for r in uniform_cells(px, span / per, k, column, dims, low).collect()]
    if method in (Cluster.MEDIANCUT_MEDIAN, Cluster.QUANTIZE_WAN, Cluster.KMEANS_MEDIANCUT, Cluster.KMEANS_WAN):
        median = method in (Cluster.MEDIANCUT_MEDIAN, Cluster.KMEANS_MEDIANCUT)
        mu = box_centres(px, cut_boxes(px, k, median, column, dims), median, column, dims)
        return mu if method in (Cluster.MEDIANCUT_MEDIAN, Cluster.QUANTIZE_WAN) else lloyd(px, mu, iterations, column)
    if method == Cluster.X_MEANS:
        raise NotImplementedError("x_means works on the pixels of a tile: use approximate.tile_centres")
    if method == Cluster.KMEANS_MSPP:
        tries = [lloyd(px, plus_plus(px, k, seed + i, 1, column), iterations, column) for i in range(trials)]
        return min(tries, key=lambda mu: cost(px, mu, column))
    seeds = random_sample(px, k, seed, column) if method == Cluster.KMEANS else plus_plus(px, k, seed, trials, column)
    return lloyd(px, seeds, iterations, column, sigma if method == Cluster.GAUSS_INV_MEANS_PP else None)
