"""MinHash near-dedup with bottom-k sketches.

Documents whose sets of word shingles have a Jaccard similarity of at least a threshold are
linked; components of linked documents share a class.

1. Equal sets: a 128-bit fingerprint of the whole set is the node; copies are one node.
2. Sketch: the k smallest shingle hashes of a node's set, from one hash function.
3. Inverted lists: sketch values are ordered by how many nodes have them, rarest first. Two
   sketches with at least o values in common share one among the first k-o+1 of each, so
   only those are put into lists. o is the least overlap that the threshold allows: exact
   where the sketch is the whole set, five standard deviations below the mean elsewhere.
4. Candidates: all pairs of a short list; in a long one each node with the list's most
   central node (the one whose values are the most frequent). The overlap of the union's
   sketch filters candidates, the exact Jaccard similarity of the whole sets verifies them.
5. What is left: a long list whose nodes are not one component yet is compared in full, in
   blocks of nodes against blocks of nodes; each pair of blocks gives the verified links
   that join components in it, so that rows follow the nodes and not their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import answers, asks, buckets_for, components, dealt, distinct, map_rows, owners, saved, scratch, tally, text_chunks, texts_in, totals

#: Values of a sketch; nodes of a list whose pairs are all candidates; nodes of a block.
SKETCH, SHORT, NODES, CHUNK = 256, 12, 256, 4 << 20
_ASKED = "chunk long, bucket int, keys binary, counts binary"


def overlap(n: int, percent: int, k: int = SKETCH) -> int:
    """How many of its sketch values a set of n shingles shares at least with one that is similar enough."""
    t, size = percent / 100, min(n, k)
    if n <= t * k:  # a similar set is no larger than k, so both sketches are whole
        return max(1, -(-percent * n // 100))
    return max(1, math.floor(t * size - 5 * math.sqrt(t * (1 - t) * size)))


def estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> tuple[float, int]:
    """(share of the union's k smallest values that both sets have, how many values that is); sets are sorted."""
    x, y = a[:k], b[:k]
    union = np.union1d(x, y)[:k]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union), len(union)


def linked(a: np.ndarray, b: np.ndarray, percent: int, k: int = SKETCH) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least percent / 100."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    t = percent / 100
    j, n = estimate(a, b, k)
    if max(len(a), len(b)) > k and j < t - 6 * math.sqrt(t * (1 - t) / n):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Chunk:
    """A chunk's shingle sets and their fingerprints."""

    def __init__(self, row: pa.RecordBatch, words: int):
        self.number = row.column("chunk")[0].as_py()
        self.ids, texts = texts_in(row)
        self.text, self.shingle, self.size, self.prints, _ = _sets(texts, words)
        self.cut = np.concatenate([[0], np.cumsum(self.size)])
        self.keys, first = np.unique(self.prints[:, 0], return_index=True)
        on = self.size[first] > 0  # without shingles: no node
        self.keys, self.first = self.keys[on], first[on]

    def own(self, blobs) -> np.ndarray:
        """The texts that stand for their set in the whole corpus."""
        return np.sort(self.first[totals(blobs) > 0]) if len(self.keys) else self.first

    def sketches(self, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(sketch values of the texts one after another, how many each has)."""
        n = np.minimum(self.size[texts], k)
        stop = np.cumsum(n)
        return self.shingle[np.repeat(self.cut[texts] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], n


def _sets(texts: pa.Array, words: int):
    w = tv.split(texts, lower=True)
    text, shingle = tv.shingle_sets(w, words)
    size = np.bincount(text, minlength=len(w.first) - 1)
    return text, shingle, size, _prints(text, shingle, size), w


def _prints(text: np.ndarray, shingle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set, from sums of mixed values and the size."""
    out = np.zeros((len(size), 2), np.uint64)
    at = np.flatnonzero(size)
    start = np.concatenate([[0], np.cumsum(size)])[at]
    if len(at):
        for i, salt in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            out[at, i] = tv.fmix(np.add.reduceat(tv.fmix(shingle ^ np.uint64(salt)), start) + size[at].astype(np.uint64))
    return out


def _nodes(prints: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(prints).tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def groups(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row of docs.

    node names the text's set of distinct shingles of `words` words (A-Z in lower case);
    a text with fewer words has its whole sequence as one shingle. A null text counts as
    empty: without words n_shingles is 0, node is null and component_id is the row's own
    doc_id. Else component_id is the smallest doc_id among all rows that are linked to this
    one through any number of links of at least percent/100; null ids are left out of
    account. Rows with the same id are rows of their own. Extra columns are ignored. A very
    long text takes part whole and makes a chunk of its own size. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        chunks = text_chunks(docs, CHUNK)
        size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_texts"), F.lit(0)).alias("docs")).first()

        def listed(row):
            c = _Chunk(row, words)
            nodes = _nodes(c.prints)
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(c.size.astype(np.int64)), pa.array(nodes.to_pylist(), pa.binary(), mask=c.size == 0)], ["doc_id", "n_shingles", "node"])

        every = saved(chunks.mapInArrow(map_rows(listed), "doc_id long, n_shingles long, node binary"), keep=True)

        def ask_prints(row):
            c = _Chunk(row, words)
            return [asks(c.number, c.keys, np.ones(len(c.keys)), buckets_for(size.docs))] if len(c.keys) else []

        mine = answers(owners(dealt(chunks.mapInArrow(map_rows(ask_prints), _ASKED), buckets_for(size.docs))), "own")
        chunks = chunks.join(mine, "chunk", "left")
        buckets = buckets_for(min(size.bytes // 5, k * size.docs))

        def ask_values(row):
            c = _Chunk(row, words)
            keys, counts = distinct(c.sketches(c.own(row.column("own")[0].as_py()), k)[0])
            return [asks(c.number, keys, counts, buckets)] if len(keys) else []

        common = answers(tally(dealt(chunks.mapInArrow(map_rows(ask_values), _ASKED), buckets)), "freq")

        def first_values(row):
            c = _Chunk(row, words)
            own = c.own(row.column("own")[0].as_py())
            values, n = c.sketches(own, k)
            if not len(values):
                return
            freq = totals(row.column("freq")[0].as_py())[np.searchsorted(distinct(values)[0], values)].astype(np.int64)
            owner = np.repeat(np.arange(len(own)), n)
            weight = np.bincount(owner, np.log2(freq)) / n
            order = np.lexsort((values, freq, owner))  # rarest first
            rank = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            least = np.array([overlap(int(x), percent, k) for x in c.size[own]])
            use = order[(rank <= (n - least)[owner]) & (freq[order] > 1)]
            nodes = _nodes(c.prints[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[use].view(np.int64)), nodes.take(pa.array(owner[use])), pa.array(c.size[own][owner[use]].astype(np.int64)), pa.array(weight[owner[use]]), pa.array(np.full(len(use), c.number))],
                ["value", "node", "n", "weight", "chunk"],
            )

        lists = saved(chunks.join(common, "chunk", "left").mapInArrow(map_rows(first_values), "value long, node binary, n long, weight double, chunk long"))
        about = saved(lists.groupBy("value").agg(F.count("*").alias("count"), F.max(F.struct("weight", "node", "n")).alias("hub")).where("count > 1").select("value", "count", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
        some = lists.select("value", "node", "n")
        short = about.where(F.col("count") <= SHORT).select("value")
        own = saved(some.join(short, "value"))
        pairs = own.join(own.select("value", F.col("node").alias("other"), F.col("n").alias("other_n")), "value").where("node < other")
        star = some.join(about.where(F.col("count") > SHORT), "value").where("node != hub").select("value", "node", "n", F.col("hub").alias("other"), F.col("hub_n").alias("other_n"))
        alike = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
        both = pairs.select("node", "n", "other", "other_n").unionByName(star.select("node", "n", "other", "other_n")).where(alike)
        pairs = saved(both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())

        # whole sets of the nodes that are compared
        long = some.join(about.where(F.col("count") > SHORT).select("value"), "value").select("node")
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(long).distinct()
        where = lists.groupBy("node").agg(F.min("chunk").alias("chunk")).join(needed, "node").groupBy("chunk").agg(F.collect_list("node").alias("nodes"))

        def whole(row):
            c = _Chunk(row, words)
            wanted = set(row.column("nodes")[0].as_py())
            nodes = _nodes(c.prints).to_pylist()
            at = [int(i) for i in c.first if nodes[i] in wanted]
            for a in range(0, len(at), 500):
                some = at[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in some], pa.binary()), pa.array([c.shingle[c.cut[i] : c.cut[i + 1]].tobytes() for i in some], pa.binary())], ["node", "shingles"])

        sets = saved(chunks.drop("own").join(where, "chunk").mapInArrow(map_rows(whole), "node binary, shingles binary"))

        def verify(batches):
            for batch in batches:
                a, b = batch.column("set_a"), batch.column("set_b")
                ok = [linked(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64), percent, k) for i in range(batch.num_rows)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        links = saved(sided.mapInArrow(verify, "a binary, b binary"))
        roots = components(links)

        # long lists that are not one component yet
        lists = some.join(about.where(F.col("count") > SHORT).select("value"), "value").select("value", "node").join(roots, "node", "left")
        lists = saved(lists.select("value", "node", F.coalesce("root", "node").alias("root")))
        open_lists = saved(lists.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("value"))
        left = saved(lists.join(open_lists, "value"))
        if left.limit(1).count():
            more = saved(_blocks(left, sets, percent))
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

        low = saved(every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")))
        low = saved(low.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
        best = saved(low.groupBy("root").agg(F.min("low").alias("component_id")))
        of = saved(low.join(best, "root").select("node", "component_id"), keep=True)
    found = every.join(of, "node").select("doc_id", "n_shingles", "node", "component_id")
    return found.unionByName(every.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))


def _blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that join different roots among the nodes of lists that overlap. left: value, node, root."""
    name = F.concat(F.lit("v"), F.col("value").cast("string")).cast("binary")  # no node has this length but by 1 in 2**64
    group = components(left.select(name.alias("a"), F.col("node").alias("b")))
    nodes = saved(left.select("node", "root").distinct().join(group.withColumnRenamed("root", "group"), "node"))
    count = nodes.groupBy("group").agg(F.ceil(F.count("*") / NODES).cast("int").alias("blocks"))
    nodes = nodes.join(saved(count), "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    nodes = nodes.select("group", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        names, root = table["node"].to_pylist(), table["root"].to_pylist()
        block = table["block"].to_numpy()
        sizes, values = [], []
        for s in table["shingles"].to_pylist():
            values.append(np.frombuffer(s, np.uint64))
            sizes.append(len(values[-1]))
        flat = np.concatenate(values)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(names)), sizes)
        keep = shared[code]
        both = np.zeros((len(names), len(names)), np.float32)
        width = int(shared.sum())
        cols, own = column[code[keep]], owner[keep]
        for a in range(0, width, 4096):  # common shingles, some columns at a time
            part = (cols >= a) & (cols < a + 4096)
            m = np.zeros((len(names), min(4096, width - a)), np.float32)
            m[own[part], cols[part] - a] = 1
            both += m @ m.T
        size = np.array(sizes)
        ok = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
        if i != j:
            ok &= block[:, None] != block[None, :]
        parent = {r: r for r in root}

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
            a, b = top(root[x]), top(root[y])
            if a != b:
                parent[a] = b
                out.append((names[x], names[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return nodes.join(sets, "node").groupBy("group", "i", "j").applyInArrow(compare, "a binary, b binary")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of groups(), that with the smallest doc_id, with the columns of docs; rows without words all stay.

    A class of null ids alone keeps one of its rows; of repeated rows one stays. Columns may
    have any names; very long texts take part whole. An empty table gives no rows.
    """
    free = "_"
    while any(c.startswith(free) for c in docs.columns):  # names that the columns of docs do not have
        free += "_"
    ident, node, name = f"{free}id", f"{free}of", f"{free}node"
    found = groups(docs, words, percent)
    stay = found.where("node is not null and (doc_id <=> component_id)").select(F.col("doc_id").alias(ident), F.col("node").alias(node)).distinct()
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def named(batches):
        for batch in batches:
            for piece in tv.slices(batch):
                _, _, size, prints, _ = _sets(piece.column(at), words)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_nodes(prints).to_pylist(), pa.binary(), mask=size == 0)], [*piece.schema.names, name])

    rows = docs.mapInArrow(named, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
    empty = rows.where(F.col(name).isNull()).drop(name)
    kept = rows.join(saved(stay), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(name) == F.col(node))).dropDuplicates([ident, node])
    return kept.select(*docs.columns).unionByName(empty)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of documents with three-word shingles and a similarity of 0.85 or more."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


SQL = {
    "op3_near_dedup": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS MATERIALIZED (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
""",
}
