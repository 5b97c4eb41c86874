"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are cut into 1, 4, 16 and 32 equal segments. From the mean m and the standard
deviation s of each segment of two vectors, the squared distance is at least
len * sum((m1-m2)^2 + (s1-s2)^2), and so the inner product (|a|^2 + |b|^2 - d^2) / 2 is at
most len * sum(m1*m2 + s1*s2). Resolutions run from coarse to fine; a pair goes on only
while its bound reaches the query's k-th best score so far, and exact integer products are
computed for the survivors alone. Nothing is approximate.

Queries and candidates are packed into blocks. One block of candidates gives each query a
first floor, the k-th best score there, so that the others send only what beats it. Every block of queries meets every block of
candidates in a task of its own (an equi-join on the block's number), so that no task, and
not the driver, ever holds either side as a whole. A task gives at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm.common import saved

_EXACT_FLOAT = 2.0**52


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _levels(dim: int) -> list[int]:
    out = [n for n in (1, 4, 16, 32) if dim % n == 0 and n * 2 <= dim]
    return out or ([1] if dim else [])


def _stats(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that a product of two rows is the bound."""
    seg = x.reshape(len(x), parts, -1)
    return np.concatenate([seg.mean(2), seg.std(2)], axis=1) * np.sqrt(seg.shape[2])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows of a with rows of b, pairwise. A score outside 64 bits wraps round."""
    return np.einsum("ij,ij->i", a, b)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT_FLOAT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query its k best rows of x (query index, row id, score), and how many products were exact.

    floor: a score for each query that k other rows are known to reach; rows below it are left out.
    """
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(q_ids):
        return none, none, none, 0
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    alive = q_ids[:, None] != ids[None, :]
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()
    slack = 1e-6 + 1e-9 * np.linalg.norm(q.astype(float), axis=1) * np.linalg.norm(x.astype(float), axis=1).max()  # for rounding
    for parts in _levels(x.shape[1]):
        bound = _stats(q.astype(float), parts) @ _stats(x.astype(float), parts).T
        bound += slack[:, None]
        bound[~alive] = -np.inf
        if len(ids) > k:  # the most promising rows, exactly: the k-th best is a floor
            seeds = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            score = np.einsum("qd,qsd->qs", q.astype(float), x[seeds].astype(float))
            score[~np.take_along_axis(alive, seeds, 1)] = -np.inf
            floor = np.maximum(floor, score.min(1) - slack)
        alive &= bound >= floor[:, None]
    qi, xi = np.nonzero(alive)
    if not len(qi):
        return none, none, none, 0
    if len(qi) * 4 > alive.size:
        score = _products(q, x)[qi, xi]
    else:
        score = np.concatenate([_exact(q[qi[a : a + 65536]], x[xi[a : a + 65536]]) for a in range(0, len(qi), 65536)])
    full = len(qi)
    some = score >= floor[qi]
    qi, xi, score = qi[some], xi[some], score[some]
    rank = np.lexsort((ids[xi], -score, qi))  # best first
    qi, got, score = qi[rank], ids[xi[rank]], score[rank]
    at = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[at < k], got[at < k], score[at < k], full


def _floors(k: int):
    """For a block of queries, the k-th best score that each has among the rows of one block."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q, ids, x = _matrices(r)
                floor = np.full(len(q_ids), -np.inf)
                qi, _, score, _ = best_in_block(q_ids, q, ids, x, k)
                at = np.arange(len(qi)) - np.searchsorted(qi, qi)
                floor[qi[at == k - 1]] = np.nextafter(score[at == k - 1].astype(float), -np.inf)  # not above it, however rounded
                yield pa.RecordBatch.from_pydict({"q": pa.array([r["q"]], pa.int64()), "floor": pa.array([floor.tobytes()], pa.binary())})

    return run


def _matrices(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of the queries and of the rows of a pair of blocks."""
    q_ids, ids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids"))
    q, x = (np.frombuffer(r[c], np.int64).reshape(len(i), r["dim"]) for c, i in (("q_data", q_ids), ("data", ids)))
    return q_ids, q, ids, x


def _pack(size: int):
    """Rows of (id, dim, v) into blocks of one dimension: (dim, block, ids, data)."""

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def out(dim):
            nonlocal n
            rows = held.pop(dim)
            ids = np.concatenate([r[0] for r in rows]).astype(np.int64)
            data = np.concatenate([r[1] for r in rows]).astype(np.int64)
            n += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([part + n], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(dims)]
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                mat = flat[(start[rows][:, None] + np.arange(dim)[None, :])] if dim else np.zeros((len(rows), 0), np.int64)
                for a in range(0, len(rows), size):
                    held.setdefault(int(dim), []).append((ids[rows[a : a + size]], mat[a : a + size]))
                    if sum(len(r[0]) for r in held[int(dim)]) >= size:
                        yield out(int(dim))
        for dim in list(held):
            yield out(dim)

    return run


_BLOCK = "dim int, block long, ids binary, data binary"


def _search(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q, ids, x = _matrices(r)
                qi, got, score, _ = best_in_block(q_ids, q, ids, x, k, np.frombuffer(r["floor"], float))
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(qi), r["q"])), "nr": pa.array(qi), "query_id": pa.array(q_ids[qi], pa.int64()), "vec_id": pa.array(got, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, query_block: int = 1024, row_block: int = 4096) -> DataFrame:
    """The k rows of `vectors` with the highest integer inner product for each row of `queries`.

    Both have vec_id and embedding; other columns are ignored. Returns query_id, rank (from
    1), vec_id, score; ties go to the smaller vec_id. Rows with the query's vec_id are its
    own and no candidates. Rows are judged each by itself: a vec_id that is repeated among
    the candidates can have several ranks, and each row of a repeated query has its own k.
    Null vectors or ids, and vectors that hold null or non-finite components, take no part;
    vectors of different lengths are not compared. With fewer than k candidates all are
    returned; empty tables give no rows. A very long vector only makes its block larger.
    """

    def blocks(df: DataFrame, size: int) -> DataFrame:
        rows = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), scale).alias("v"))
        return saved(rows.mapInArrow(_pack(size), _BLOCK))

    q = blocks(queries, query_block).select("dim", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    x = blocks(vectors, row_block)
    # one block of each dimension gives every query a score to beat, before the others are looked at
    numbers = x.select("dim", "block")
    first = numbers.groupBy("dim").agg(F.min("block").alias("block"))
    pairs = q.join(first, "dim").join(x.drop("dim"), "block")
    q = q.join(saved(pairs.select("q", "dim", "q_ids", "q_data", "ids", "data").mapInArrow(_floors(k), "q long, floor binary")), "q")
    # a row for each pair of blocks: numbers first, then the blocks themselves by equi-joins
    todo = numbers.join(q.select("dim", "q"), "dim")
    todo = todo.join(q.drop("dim"), "q").repartition("block", "q").join(x.drop("dim"), "block")
    found = todo.select("dim", "q", "q_ids", "q_data", "floor", "ids", "data").mapInArrow(_search(k), "q long, nr long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "nr").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


SQL = {
    "op5_exact_topk": """
WITH ok AS (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.nr, q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
}
