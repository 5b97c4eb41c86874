"""Substring dedup by level-wise doubling.

Wanted are the words covered by windows of n words that occur elsewhere too. A window can
only repeat if every shorter window in it does, so windows are judged at a quarter of n
first, then at twice that, and so on up to n: only windows that repeat at one length are
looked at in the next, and the levels end when none are left.

Below n, a window is judged by one of its parts alone: of the parts of the level's length
in it, the one with the smallest hash. Equal windows choose the same part, so none is
lost, and neighbouring windows mostly share theirs, so that few parts are counted. At n
itself the whole window counts, and those that have repeated once more with a hash of other
word hashes, independent of the first: two different windows are taken for equal only if
both of its 64-bit hashes collide.

Parts are counted over the whole corpus by ranges of their hash; texts stay in their chunk
and get back what their parts' counts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import about, answers, asks, buckets_for, dealt, distinct, map_rows, tally, text_chunks, texts_in, totals

WORDS, CHUNK = 35, 4 << 20


def levels(n: int) -> list[int]:
    """Lengths of the levels: from about a quarter of n (4 words at least) doubling up to n, and n again for the second hash."""
    out = [max(-(-n // 4), min(n, 4))]
    while out[-1] < n:
        out.append(min(2 * out[-1], n))
    return [*out, n]


def _least(h: np.ndarray, m: int) -> np.ndarray:
    """For each place the place of the smallest of m values from there on, the leftmost if there are several."""
    at, size = np.arange(len(h), dtype=np.int32), 1
    while size < m:
        step = min(size, m - size)
        left = h[:-step] <= h[step:]
        h, at, size = np.where(left, h[:-step], h[step:]), np.where(left, at[:-step], at[step:]), size + step
    return at


class _Chunk:
    """A chunk's windows, judged level by level. Texts without windows left are not looked at again."""

    def __init__(self, row: pa.RecordBatch, n: int):
        self.n, self.number = n, row.column("chunk")[0].as_py()
        self.ids, texts = texts_in(row)
        self.words = tv.split(texts)
        self.hashes, self.index = self.words.hashes, None
        self.alive = self.words.windows(n).astype(np.int32)
        self._drop()

    def _drop(self) -> None:
        """Leaves out the words of texts without windows: hashes holds the rest, index their places."""
        w = self.words
        place = self.alive if self.index is None else self.index[self.alive]
        live = np.zeros(len(w.first) - 1, bool)
        live[np.searchsorted(w.first, place, "right") - 1] = True
        keep = np.repeat(live, w.counts)
        self.index = np.flatnonzero(keep).astype(np.int32)
        self.hashes = w.hashes[self.index]
        self.alive = (np.cumsum(keep, dtype=np.int32) - 1)[place]

    def ask(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, their counts, key of each alive window)."""
        size, last = levels(self.n)[level], level == len(levels(self.n)) - 1
        if not len(self.alive):
            return self.hashes[:0], np.zeros(0, np.int64), self.hashes[:0]
        h = tv.gram(self.words.again()[self.index] if last else self.hashes, size)
        part = self.alive if size == self.n else _least(h, self.n - size + 1)[self.alive]
        chosen = np.zeros(len(h), bool)
        chosen[part] = True
        # the smallest hashes crowd at the low end: mixed again, they fill all ranges alike
        return *distinct(tv.fmix(h[chosen])), tv.fmix(h[part])

    def judge(self, level: int, blobs) -> None:
        """Leaves the windows whose part is in more than one place."""
        keys, _, own = self.ask(level)
        if len(own):
            twice = keys[totals(blobs) > 1]
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1) if len(twice) else None
            self.alive = self.alive[twice[at] == own] if len(twice) else self.alive[:0]
            self._drop()

    def removed(self) -> np.ndarray:
        """Whether each word is covered by a window that is left."""
        step, at = np.zeros(len(self.words.starts) + 1, np.int32), self.index[self.alive]
        step[at] += 1
        np.subtract.at(step, at + self.n, 1)
        return np.cumsum(step[:-1]) > 0

    def kept(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(words removed of each text, its kept words joined by one space, its removed word ranges)."""
        w, gone = self.words, self.removed()
        of, n_texts = w.text_of(), len(w.first) - 1
        keep = np.flatnonzero(~gone)
        last = np.ones(len(keep), bool)
        last[:-1] = of[keep[1:]] != of[keep[:-1]]
        # a kept word with the byte after it, which becomes a space, unless it is its text's last
        stop = w.ends[keep] + ~last
        step = np.zeros(len(w.data) + 1, np.int8)
        step[w.starts[keep]] += 1
        np.subtract.at(step, stop, np.int8(1))
        data = np.append(w.data, np.uint8(0))
        data[w.ends[keep][~last]] = 0x20
        text = data[:-1][np.cumsum(step[:-1], dtype=np.int8) > 0]
        size = np.bincount(of[keep], stop - w.starts[keep], n_texts).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        texts = pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin, end = _by_text(begin, end, w.first)
        owner = np.searchsorted(w.first, begin, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(n_texts + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(begin - w.first[owner], pa.int32()), pa.array(end - w.first[owner], pa.int32())], ["start", "stop"]),
        )
        return np.bincount(of[gone], minlength=n_texts), texts, spans


def _by_text(begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges cut where a text begins inside them."""
    inner = first[1:-1]
    at = np.searchsorted(begin, inner, "right") - 1
    hit = (at >= 0) & (inner > begin[np.maximum(at, 0)]) & (inner < end[np.maximum(at, 0)]) if len(begin) else np.zeros(len(inner), bool)
    cut = np.unique(inner[hit])
    return np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))


def remove_repeats(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), removed (word ranges) of every row.

    Removed is each word that is covered by a window of n consecutive words of its text
    which also starts at another place of this or another text; windows are judged on the
    input. Words are runs without ASCII white space, unchanged. A null text counts as empty;
    texts of fewer than n words lose nothing. Repeated rows repeat each other, whatever
    their ids are; every row gives one row. Columns other than doc_id and text are ignored.
    A very long text is judged whole and makes a chunk of its own size.
    """
    chunks = text_chunks(docs, CHUNK)
    words = int(chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]) // 5  # about
    judged, sizes = chunks, levels(n)
    asked_by = "chunk long, bucket int, keys binary, counts binary"
    for level, size in enumerate(sizes):
        # neighbouring windows share their part: of a text's parts about 2 in n-size+2 are chosen
        buckets = buckets_for(2 * words // (n - size + 2) if size < n else words // 2)

        def ask(row, level=level, buckets=buckets):
            c = _Chunk(row, n)
            for k in range(level):
                c.judge(k, row.column(f"totals{k}")[0].as_py())
            keys, counts, _ = c.ask(level)
            return [asks(c.number, keys, counts, buckets)] if len(keys) else []

        told = tally(dealt(judged.mapInArrow(map_rows(ask), asked_by), buckets))
        judged = judged.join(answers(told, f"totals{level}"), "chunk", "left")
        parts, once, _ = about(told)
        if parts == once:  # no part is in two places: no window is left
            sizes = sizes[: level + 1]
            break

    def run(row):
        c = _Chunk(row, n)
        for k in range(len(sizes)):
            c.judge(k, row.column(f"totals{k}")[0].as_py())
        gone, texts, spans = c.kept()
        yield pa.RecordBatch.from_arrays([c.ids, pa.array(c.words.counts), pa.array(gone), texts.cast(pa.string()), spans], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return judged.mapInArrow(map_rows(run), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,stop:int>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words repeat, and a digest of what is left."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(list_slice(w, i, i + 34), ' ')))) AS m
  FROM d WHERE len(w) >= 35
),
again AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM h JOIN again USING (m)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
}
