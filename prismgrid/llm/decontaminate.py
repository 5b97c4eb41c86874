"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents may be thousands of times longer, so a document's own MinHash
signature says next to nothing of an item in it (the Jaccard similarity is tiny, and
banding of document signatures would need thousands of rows). The sketch is therefore on
the item's side alone: its smallest shingle hashes, looked up among all the document's
shingles, estimate what share of the item the document contains (containment MinHash,
Koslicki and Zabeti, 2019). Items are partitioned by their number of shingles; a partition
fixes the sketch's length and how many of its values a document must have, five standard
deviations below the expected number at the threshold. Candidates are verified by exact
containment of the whole shingle sets.

An item of fewer words than a shingle has its whole word sequence as its one shingle; it is
a partition by its number of words and is looked for among the documents' sequences of
that length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import texts_of

WORDS, SHARE = 5, 0.8
#: Shingles of items that are broadcast at once; more items are searched in more blocks.
BLOCK_SHINGLES = 2_000_000


def _need(n: int, share: float) -> int:
    """The least number of shingles of n that is at least this share."""
    return math.ceil(share * n - 1e-9)


def partition(n: int, share: float) -> tuple[int, int]:
    """For items of n shingles: length of the sketch, and how many of its values a candidate has at least."""
    k = 32 if n <= 256 else 64
    if n <= k:
        return n, _need(n, share)
    sd = math.sqrt(k * share * (1 - share))
    return k, max(1, math.floor(k * share - 5 * sd))


@dataclass(frozen=True)
class Items:
    """A block of items: ids, sorted shingle sets, and the sketches as (value, item) pairs sorted by value."""

    ids: np.ndarray
    sets: list[np.ndarray]
    values: np.ndarray
    items: np.ndarray
    least: np.ndarray
    share: float
    #: The short items by their number of words: (sorted hashes of their sequences, their items).
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[int], sets: list[np.ndarray], sizes: list[int], share: float) -> Items:
        """sizes: words of each item that has fewer than a shingle, else 0; its set is its sequence's hash."""
        plan = [(0, 1) if n else partition(len(s), share) for s, n in zip(sets, sizes, strict=True)]
        values = np.concatenate([s[:k] for s, (k, _) in zip(sets, plan, strict=True)])
        items = np.repeat(np.arange(len(sets)), [k for k, _ in plan])
        order = np.argsort(values, kind="stable")
        short = {}
        for n in sorted(set(sizes) - {0}):
            at = np.flatnonzero(np.array(sizes) == n)
            h = np.array([sets[i][0] for i in at], np.uint64)
            rank = np.argsort(h, kind="stable")
            short[n] = h[rank], at[rank]
        return cls(np.array(ids, np.int64), sets, values[order], items[order], np.array([m for _, m in plan]), share, short)

    def found(self, texts: pa.Array, words: int) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) of all pairs that reach the share."""
        w = tv.split(texts, lower=True)
        out = self.search(*tv.shingle_sets(w, words)) if len(self.values) else []
        of = w.text_of()
        for n, (h, items) in self.short.items():
            at = w.windows(n)
            own = tv.gram(w.hashes, n)[at] if len(at) else w.hashes[:0]
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            hit = np.flatnonzero(hi > lo)
            pairs = {(int(of[at[i]]), int(items[j])) for i in hit for j in range(lo[i], hi[i])}
            out += [(t, i, 1) for t, i in sorted(pairs)]
        return out

    def search(self, text: np.ndarray, shingle: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) of all pairs that reach the share; text and shingle as from shingle_sets()."""
        lo = np.searchsorted(self.values, shingle, "left")
        hit = np.flatnonzero((lo < len(self.values)) & (self.values[np.minimum(lo, len(self.values) - 1)] == shingle))
        if not len(hit):
            return []
        n = np.searchsorted(self.values, shingle[hit], "right") - lo[hit]
        at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs, count = np.unique(np.repeat(text[hit], n) * len(self.ids) + self.items[at], return_counts=True)
        pairs = pairs[count >= self.least[pairs % len(self.ids)]]
        out = []
        for p in pairs:
            t, i = int(p // len(self.ids)), int(p % len(self.ids))
            own = shingle[np.searchsorted(text, t) : np.searchsorted(text, t + 1)]
            where = np.searchsorted(own, self.sets[i])
            found = int((own[np.minimum(where, len(own) - 1)] == self.sets[i]).sum())
            if found >= _need(len(self.sets[i]), self.share):
                out.append((t, i, found))
        return out


def _blocks(items: DataFrame, words: int, share: float, most: int) -> Iterator[Items]:
    """The items in blocks of at most about `most` shingles; the driver holds one block at a time. Null ids become 0."""

    def run(batches):
        for batch in batches:
            for piece in tv.slices(batch):
                w = tv.split(piece.column("text"), lower=True)
                text, h = tv.shingle_sets(w, words)
                keep = np.flatnonzero(w.counts)
                cut = np.searchsorted(text, np.arange(piece.num_rows + 1))
                sets = [h[cut[i] : cut[i + 1]] if w.counts[i] >= words else tv.gram(w.hashes[w.first[i] : w.first[i + 1]], int(w.counts[i])) for i in keep]
                short = np.where(w.counts[keep] < words, w.counts[keep], 0)
                yield pa.RecordBatch.from_arrays([piece.column("item_id").take(pa.array(keep)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(short, pa.int32())], ["item_id", "shingles", "short"])

    ids, sets, sizes, size = [], [], [], 0
    for row in texts_of(items, "item_id").mapInArrow(run, "item_id long, shingles binary, short int").toLocalIterator():
        s = np.frombuffer(bytes(row.shingles), np.uint64)
        if sets and size + len(s) > most:
            yield Items.build(ids, sets, sizes, share)
            ids, sets, sizes, size = [], [], [], 0
        ids.append(row.item_id or 0)
        sets.append(s)
        sizes.append(row.short)
        size += len(s)
    if sets:
        yield Items.build(ids, sets, sizes, share)


def contained(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE, most: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_found: documents that hold at least this share of an item's word shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are runs
    without ASCII white space, A-Z in lower case. An item of fewer than `words` words has its
    whole sequence as its one shingle, and a document that has these words in a row holds it.
    Null and empty texts match nothing, nor do items with a null id. Rows with the same id are
    judged each by itself. A very long text is searched whole. An empty table on either side
    gives no rows.
    """
    schema = "doc_id long, item_id long, n_item long, n_found long"
    spark, docs, out = docs.sparkSession, texts_of(docs, "doc_id"), None
    for block in _blocks(items.where("item_id is not null"), words, share, most):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            block = held.value
            for batch in batches:
                for piece in tv.slices(batch):
                    found = block.found(piece.column("text"), words)
                    t, i, n = (np.array([x[c] for x in found], np.int64) for c in range(3))
                    size = np.array([len(block.sets[x]) for x in i], np.int64)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(t)), pa.array(block.ids[i], pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "n_item", "n_found"])
            tv.give_back()

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE, most: int = BLOCK_SHINGLES) -> DataFrame:
    """docs without the rows that hold an item to this share, with the columns it came with; other rows are kept as they are.

    Items with a null id count as well. Null and empty texts stay, and so does every row if
    there are no items; very long texts are searched whole.
    """
    spark = docs.sparkSession
    for block in _blocks(items, words, share, most):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                for piece in tv.slices(batch):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[t for t, _, _ in held.value.found(piece.column(piece.schema.get_field_index("text")), words)]] = False
                    yield piece.filter(pa.array(keep))
            tv.give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds to 0.8 or more, in five-word shingles."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_WORDS = """
  SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
"""
SQL = {
    "op7_decontaminate": f"""
WITH iw AS ({_WORDS.format(id="item_id", table="benchmark")}), dw AS ({_WORDS.format(id="doc_id", table="documents")}),
z AS (SELECT DISTINCT least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN z WHERE len(w) >= n)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, CAST(count(*) AS BIGINT) AS n_found
FROM d JOIN i USING (n, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= CAST(ceil(0.8 * n_item - 1e-9) AS BIGINT)
""",
}
