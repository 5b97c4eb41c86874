"""Quality classifier: Naive Bayes features under a linear support vector machine.

Wang and Manning (2012): n-gram indicators are scaled by the log-count ratio of the two
classes, and a linear hinge-loss model is fitted to them, here by dual coordinate descent
(Hsieh et al., 2008). Margins become scores from 0 to 1 by a logistic curve fitted on a
fifth of the sample that the weights have not seen.

Features are hashed indicators: each word; each word's shape (case, first and last
characters, length, whether it repeats the word before it); pairs and triples of shapes;
and the share of words of each coarse shape, in steps. All of a text counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import texts_of

BITS = 18
#: Labelled rows that the model is fitted on at most: those with the smallest hash of doc_id.
SAMPLE = 20_000

_CLASS = np.zeros(256, np.uint64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 not ASCII, else the byte of a mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_MARKS] = _MARKS
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True  # letters beyond ASCII tell nothing of the case
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: (text, feature), sorted. An empty text has the feature of emptiness alone."""
    w = tv.split(texts, lower=True)
    n, of = len(w.first) - 1, w.text_of()
    size = w.ends - w.starts
    empty = np.flatnonzero(w.counts == 0)
    keys = [(empty, np.zeros(len(empty), np.uint64))]
    if len(of):
        lower = np.add.reduceat(_LOWER[w.data].astype(np.int32), w.starts)
        upper = np.add.reduceat(_UPPER[w.data].astype(np.int32), w.starts)
        again = np.zeros(len(of), bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
        case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 1, np.where(upper > 1, 2, 3))).astype(np.uint64)
        first, last = _CLASS[w.data[w.starts]], _CLASS[w.data[w.ends - 1]]
        before = np.where(size > 1, _CLASS[w.data[np.maximum(w.ends - 2, 0)]], np.uint64(0))
        length = np.searchsorted([1, 2, 3, 5, 9, 16, 40], size, "right").astype(np.uint64)
        shape = (((first * np.uint64(128) + last) * np.uint64(128) + before) * np.uint64(8) + case) * np.uint64(2) + again.astype(np.uint64)
        full = tv.fmix(shape * np.uint64(16) + length + np.uint64(1))
        shape = tv.fmix(shape + np.uint64(0x51ED270B))
        coarse = np.where(again, 4, np.where(last >= 33, np.where(before >= 33, 5, 6), case.astype(np.int64)))
        share = np.bincount(of * 7 + coarse, minlength=7 * n).reshape(n, 7) / np.maximum(w.counts, 1)[:, None]
        step = np.ceil(share * 20).astype(np.uint64) + np.arange(7, dtype=np.uint64) * np.uint64(64) + np.uint64(7000)
        keys += [(of, w.hashes), (of, full), (np.repeat(np.arange(n), 7), tv.fmix(step.ravel()))]
        for k in (2, 3):
            at = w.windows(k)
            keys.append((of[at], tv.gram(shape, k)[at]))
    flat = np.concatenate([t.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64) for t, h in keys])
    flat.sort()
    flat = flat[np.r_[True, flat[1:] != flat[:-1]]] if len(flat) else flat
    return flat >> BITS, flat & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = sum of weights / sqrt(sum of squares) + bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float
    known: bool = True  # fitted on rows of both classes

    def margins(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(text, self.weights[feature], n)
        norm = np.sqrt(np.bincount(text, self.squares[feature], n))
        return total / np.maximum(norm, 1e-12) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature = features(texts)
        m = self.margins(text, feature, len(texts)) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def _descend(rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine, by dual coordinate descent; feature rows (index, value)."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            grad = y[i] * (w[idx] @ val) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), cost[i])  # every row has squared norm 2: 1 and the bias
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * val
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit(sets: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """A model from the feature sets and 0/1 labels of the sample. One class alone gives its constant score."""
    n = 1 << BITS
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        return Model(np.zeros(n), np.ones(n), 0.0, 0.0, 0.0 if not len(y) else 4.0 * y[0], known=False)
    order = np.random.default_rng(seed).permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    train = order[len(y) // 5 :] if len(y) >= 50 else order
    if (y[train] == y[train[0]]).all() or (y[held] == y[held[0]]).all():
        held = train = order
    count = {s: np.bincount(np.concatenate([sets[i] for i in train if y[i] == s]), minlength=n) + 1.0 for s in (1.0, -1.0)}
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    ratio[(count[1.0] + count[-1.0]) < 4] = 0.0  # seen once: it says nothing of other texts
    rows = []
    for i in train:
        v = ratio[sets[i]]
        rows.append((np.append(sets[i], n).astype(np.int32), np.append(v / max(np.sqrt(v @ v), 1e-12), 1.0).astype(np.float32)))
    share = (y[train] > 0).mean()
    weight = np.where(y[train] > 0, 0.5 / share, 0.5 / (1 - share))
    w = _descend(rows, y[train], cost * weight, epochs, seed)
    model = Model(w[:n] * ratio, ratio**2, float(w[n]), 1.0, 0.0)
    m = np.array([model.margins(np.zeros(len(sets[i]), np.int64), sets[i], 1)[0] for i in held])
    a, b, t = 1.0, 0.0, np.where(y[held] > 0, 1.0, 0.0)
    for _ in range(60):  # Newton steps on the logistic loss, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(p - t) @ m + 1e-2 * a, (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ (m * m) + 1e-2, s @ m], [s @ m, s.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
        a, b = float(np.clip(a, 0.1, 50)), float(np.clip(b, -50, 50))
    return Model(model.weights, model.squares, model.bias, a, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows of docs, at most `sample` of them: those with the smallest hash of doc_id.

    labels: doc_id, quality (0/1). Repeated labels of a doc_id count as 1 if any is; null
    ids and labels are left out. The sample of ids is bounded and so broadcast; texts
    become feature sets where they are, and only these come to the driver. Null texts count
    as empty, rows with the same id are rows of their own, and the whole of a very long text
    counts; other columns are ignored. Without labelled rows the model knows nothing.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for piece in tv.slices(batch):
                text, feature = features(piece.column("text"))
                cut = np.searchsorted(text, np.arange(piece.num_rows + 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array([tv.pack(feature[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "label", "features"])
        tv.give_back()

    rows = texts_of(docs, "doc_id").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(run, "doc_id long, label int, features binary").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["features"][i]))  # the same in every run
    labels = np.array([got["label"][i] for i in order])
    sets = [tv.unpack(got["features"][i], np.uint32).astype(np.int32) for i in order]
    del got
    model = fit(sets, labels)
    del sets
    tv.give_back()
    return model


def score(docs: DataFrame, model: Model, columns: list[str], schema: str) -> DataFrame:
    """The columns of docs named, with `score`. Null and empty texts are scored as empty, very long ones whole; every row gives one row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(held.value.scores(piece.column("text")), pa.float64())], [*columns, "score"])
        tv.give_back()

    return docs.mapInArrow(run, f"{schema}, score double")


def rejects(spark, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is below the threshold, with the columns it came with.

    Where the labels do not have rows of both classes, nothing is known and all rows stay.
    """
    model = train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    if not model.known:
        return docs
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in tv.slices(batch):
                yield piece.filter(pa.array(held.value.scores(piece.column(at)) >= threshold))
        tv.give_back()

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; rows whose crc32(doc_id) mod 4 is 2 are held out of the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held))
    out = score(texts_of(docs, "doc_id"), model, ["doc_id"], "doc_id long")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
