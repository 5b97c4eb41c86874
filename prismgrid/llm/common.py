"""What the operators share: the shared folder, chunk tables, corpus-wide counts, components."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own if all tasks run in the driver's process; an
    error on a cluster, whose machines would each write to their own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="prismgrid-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


class _Scratch(threading.local):
    """The scratch() blocks that a thread is in, each with its tables."""

    def __init__(self):
        self.blocks: list[list[tuple[str, str]]] = []


_SCRATCH = _Scratch()


def _remove(spark: SparkSession, path: str, table: str) -> None:
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended  # noqa: BLE001
        pass


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are saved inside go at its end, but for those saved with keep: results must not read the others."""
    _SCRATCH.blocks.append([])
    try:
        yield
    finally:
        for path, table in _SCRATCH.blocks.pop():
            _remove(spark, path, table)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it ends, not when the driver's garbage collection finds them.

    For queries whose result is collected or saved: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Bytes of input for a bucket of a chunk table, about.
BUCKET_BYTES = 128 << 20


def buckets_of(df: DataFrame) -> int:
    """Into how many buckets to lay out a table made of df: by the size of its sources, one a shuffle partition at least.

    The size is what Spark knows of the files; sources of unknown size count for nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    known = sum(x for x in sizes if x < 2**60)  # Spark gives 2**63 - 1 where it does not know
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // BUCKET_BYTES, most))


def saved(df: DataFrame, bucket: str | None = None, keep: bool = False, dealt: bool = False, buckets: int | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage and survives lost executors.

    bucket: lay the table out by this column, so that joins on it move only the other side,
    into so many buckets (shuffle partitions);
    dealt: with a shuffle before, for one file a bucket in place of one a task and bucket.
    The table goes with the innermost scratch(), with the one around that if keep, or when
    the driver ends.
    """
    spark = df.sparkSession
    name = f"prismgrid_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    around = _SCRATCH.blocks[: len(_SCRATCH.blocks) - keep]
    if around:
        around[-1].append((path, name if bucket else ""))
    else:
        atexit.register(_remove, spark, path, name if bucket else "")
    if bucket is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if dealt:
        df = df.repartition(n, bucket)
    df.write.bucketBy(n, bucket).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows gathered to about `most` bytes of text, each with a number that is the same in every attempt of the task."""
    part, k = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in tv.slices(batch, most=most):
            n = piece.column(piece.schema.get_field_index("text")).nbytes
            if held and size + n > most:
                yield part + k, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, k = [], 0, k + 1
            held.append(piece)
            size += n
    if held:
        yield part + k, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held.clear()
    tv.give_back()


_TEXTS = "chunk long, n_texts long, n_bytes long, ids binary, no_id binary, offsets binary, texts binary"


def text_chunks(docs: DataFrame, most: int) -> DataFrame:
    """doc_id and text of all rows as a saved table with a row for about `most` bytes of text, for texts_in().

    Texts are compressed, so that what passes through Spark is small, and read again at
    each pass; joins on chunk move only the other side.
    """

    def pack(batches):
        for chunk, batch in chunked(batches, most):
            data, offsets = tv.buffers(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            row = {
                "chunk": chunk, "n_texts": batch.num_rows, "n_bytes": len(data), "ids": tv.pack(ids.fill_null(0).to_numpy(zero_copy_only=False)),
                "no_id": tv.pack(np.asarray(ids.is_null()).astype(np.uint8)), "offsets": tv.pack(offsets), "texts": pa.compress(pa.py_buffer(data), codec="zstd", asbytes=True),
            }
            yield pa.RecordBatch.from_pylist([row])

    docs = texts_of(docs, "doc_id")
    return saved(docs.mapInArrow(pack, _TEXTS), bucket="chunk", dealt=True, buckets=buckets_of(docs))


def texts_in(row: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a row of text_chunks()."""
    get = lambda c: row.column(c)[0].as_py()
    offsets = tv.unpack(get("offsets"), np.int64)
    data = pa.decompress(get("texts"), decompressed_size=int(offsets[-1]), codec="zstd")
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), data])
    return pa.array(tv.unpack(get("ids"), np.int64), mask=tv.unpack(get("no_id"), np.uint8).astype(bool)), texts


def texts_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns asked for; text as a string, null as empty."""
    return df.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


# ---- counts over the whole corpus ----------------------------------------------------

TALLY_IN = "chunk long, bucket int, keys binary, counts binary"
_TALLY_OUT = "chunk long, bucket int, totals binary"


def buckets_for(items: int, each: int = 1_000_000) -> int:
    """How many ranges of hashes to count apart, so that one holds about `each` entries."""
    return max(8, math.ceil(items / each))


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of ascending keys into `buckets` equal ranges of the hash space."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def asks(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a chunk contributes to, and asks of, tally(): ascending distinct keys with counts."""
    cut = by_bucket(keys, buckets)
    on = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(on), pa.int64()),
            pa.array(on, pa.int32()),
            pa.array([tv.pack_sorted(keys[cut[b] : cut[b + 1]]) for b in on], pa.binary()),
            pa.array([tv.pack(counts[cut[b] : cut[b + 1]].astype(np.uint64)) for b in on], pa.binary()),
        ],
        ["chunk", "bucket", "keys", "counts"],
    )


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket and where each row's end."""
    keys = [tv.unpack_sorted(x) for x in table["keys"].to_pylist()]
    return np.concatenate(keys), np.cumsum([len(k) for k in keys])


def _own_bucket(table: pa.Table) -> pa.Table:
    """1 for the keys whose smallest chunk asks, else 0."""
    flat, ends = _flat(table)
    chunk = np.repeat(table["chunk"].to_numpy(), np.diff(ends, prepend=0))
    order = np.lexsort((chunk, flat))
    flat = flat[order]
    out = np.empty(len(flat), np.uint64)
    out[order] = np.r_[True, flat[1:] != flat[:-1]]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "totals": pa.array([tv.pack(x) for x in np.split(out, ends[:-1])], pa.binary())})


def _sum_bucket(table: pa.Table) -> pa.Table:
    flat, ends = _flat(table)
    counts = np.concatenate([tv.unpack(x, np.uint64) for x in table["counts"].to_pylist()])
    order = np.argsort(flat)
    flat = flat[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    out = np.empty(len(flat), np.uint64)
    out[order] = total[np.cumsum(new) - 1]
    parts = np.split(out, ends[:-1])
    # and one row of the bucket's own: how many keys have a total of 1 or more, of 1, of 2
    about = tv.pack(np.array([(total >= 1).sum(), (total == 1).sum(), (total == 2).sum()], np.uint64))
    bucket = table["bucket"].to_pylist()
    return pa.table({"chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int32()), "totals": pa.array([*(tv.pack(x) for x in parts), about], pa.binary())})


def dealt(asked: DataFrame, buckets: int) -> DataFrame:
    """The rows of asks() with a task for each bucket: Spark would put buckets together by its number of cores."""
    return asked.repartitionById(buckets, F.col("bucket"))


def tally(asked: DataFrame) -> DataFrame:
    """Total of each key over all chunks, given back to each chunk that has the key.

    asked has the rows of asks(), dealt() or not. Keys go to tasks by ranges of their hash,
    once a chunk however often they occur in it, so that a frequent key is no hot spot. The
    result is for answers() and about().
    """
    return saved(asked.groupBy("bucket").applyInArrow(_sum_bucket, _TALLY_OUT))


def owners(asked: DataFrame) -> DataFrame:
    """Like tally(), but each chunk gets 1 for the keys that no chunk with a smaller number has, else 0."""
    return saved(asked.groupBy("bucket").applyInArrow(_own_bucket, _TALLY_OUT))


def answers(tallied: DataFrame, name: str) -> DataFrame:
    """A row a chunk: packed totals (for totals()) in the order of the chunk's keys."""
    rows = tallied.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("a"))
    return rows.select("chunk", F.col("a.totals").alias(name))


def about(tallied: DataFrame) -> tuple[int, int, int]:
    """How many keys have a total of 1 or more, of 1, and of 2: a few numbers from each bucket, summed."""
    sums = [0, 0, 0]
    for row in tallied.where("chunk < 0").select("totals").toLocalIterator():
        sums = [a + int(b) for a, b in zip(sums, tv.unpack(bytes(row.totals), np.uint64), strict=True)]
    return tuple(sums)


def totals(blobs: list[bytes] | None) -> np.ndarray:
    """The totals of a chunk as one array."""
    return np.concatenate([tv.unpack(b, np.uint64) for b in blobs]).view(np.int64) if blobs else np.zeros(0, np.int64)


def map_rows(fn: Callable[[dict], Iterator[pa.RecordBatch] | list[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gets one row at a time, as a record batch of one row."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn(batch.slice(i, 1))
        tv.give_back()

    return run


# ---- connected components ------------------------------------------------------------


def _forest(batches):
    """The edges of a partition as a forest: (u, v) with v the smallest node that u is connected to here."""
    parent: dict = {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, top(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for i in range(0, len(pairs), 100_000):
        u, v = zip(*pairs[i : i + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", each: int = 500_000, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node (binary) with an edge to another; root is the component's smallest node.

    Partitions of about `each` edges become forests where they are; one partition is done
    with that. The forests of several are joined by the large-star and small-star steps
    (Kiveris et al., 2014) until the edges stay as they are. No step needs the neighbours
    of one node together: minima are partial aggregates, and the joins are ones whose
    skewed partitions can be split.
    """
    with scratch(edges.sparkSession):
        edges = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v"))
        parts = max(1, math.ceil(edges.count() / each))
        edges = saved((edges.repartition(parts) if parts > 1 else edges.coalesce(1)).mapInArrow(_forest, "u binary, v binary"))
        before = None
        for _ in range(most_rounds if parts > 1 else 0):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            # large star: neighbours above u go to the least of u and its neighbours
            large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
            # small star: neighbours below u, and u itself, go to the least of them
            linked = large.join(low, "u")
            small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            edges = saved(small.distinct())
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == before:
                break
            before = now
        else:
            if parts > 1:
                raise RuntimeError("components: no end after the allowed rounds")
        out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return saved(out, keep=True)
