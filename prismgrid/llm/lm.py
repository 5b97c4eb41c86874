"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model over words and an end of text. States are contexts seen in
training; a state has an arc for each word seen after it, and a failure arc to the state of
the context without its first word. With c counts in training and m a parameter,

    P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m)        h' is h without its first word

so an arc's weight is the log of the whole, and a failure arc's is log(m / (c(h) + m)); the
weights out of a state sum to one. At the bottom is the root, the unigram state, absolutely
discounted: P(w) = (c(w) - d) / N for the V words seen. The mass d V / N that is left is that
of words never seen, of which the model reckons with V: each has the V-th part.

A chunk of texts builds the part of the automaton that its texts can reach and goes through
it once, left to right, carrying the state: an arc if the state has one for the word, else
failure arcs until a state has. As a state never tells more than the words before, a text is
cut into lanes that start a few words early, at the root, and go side by side.

Counts are exact, over all training texts. They are never gathered in one place: each chunk
asks the tasks that count a range of n-gram hashes for what it needs. N-grams are told apart
by 64-bit hashes. What is exchanged grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import TALLY_IN, about, answers, asks, buckets_for, buckets_of, chunked, dealt, distinct, map_rows, saved, tally, texts_of, tidy, totals

#: Order of the model, the m of each order above the first, text bytes in a chunk, and tokens in a lane.
ORDER, STRENGTH, CHUNK, LANE = 3, 100.0, 4 << 20, 256
_END, _START = (int(x) for x in tv.fmix(np.array([11, 13], np.uint64)))

_CHUNKS = "chunk long, n_tokens long, n_train long, n_texts long, n_keys long, ids binary, no_id binary, held binary, counts binary, keys binary, codes binary"


def _chunks(batches):
    """Texts as rows of _CHUNKS: distinct words and, for every token, the number of its word."""
    for chunk, batch in chunked(batches, CHUNK):
        w = tv.split(batch.column("text"), lower=True)
        hashes = np.insert(w.hashes, w.first[1:], np.uint64(_END))
        counts = w.counts + 1
        code, seen = pd.factorize(hashes)
        order = np.argsort(seen)
        place = np.empty(len(seen), np.uint32)
        place[order] = np.arange(len(seen), dtype=np.uint32)
        ids = batch.column("doc_id")
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        row = {
            "chunk": chunk, "n_tokens": len(hashes), "n_train": int(counts[~held].sum()), "n_texts": int((~held).sum()), "n_keys": len(seen),
            "ids": tv.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), "no_id": tv.pack(np.asarray(ids.is_null()).astype(np.uint8)),
            "held": tv.pack(held.astype(np.uint8)), "counts": tv.pack(counts.astype(np.uint32)), "keys": tv.pack_sorted(seen[order]), "codes": tv.pack(place[code]),
        }
        yield pa.RecordBatch.from_pylist([row])


class _Chunk:
    """A chunk read again: its texts' tokens and the n-grams that end at each."""

    def __init__(self, row: pa.RecordBatch):
        get = lambda c: row.column(c)[0].as_py()
        self.number = get("chunk")
        self.counts = tv.unpack(get("counts"), np.uint32).astype(np.int64)
        self.held = tv.unpack(get("held"), np.uint8).astype(bool)
        self.keys, self.codes = tv.unpack_sorted(get("keys")), tv.unpack(get("codes"), np.uint32)
        self.train = np.repeat(~self.held, self.counts)
        stop = np.cumsum(self.counts)
        self.first = stop - self.counts
        self.row = row

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that end an n-gram, its hash). The start of a text is a word before the first."""
        ext = np.insert(self.keys[self.codes], self.first, np.uint64(_START))
        at = np.arange(len(self.codes)) - np.repeat(self.first, self.counts)
        on = np.flatnonzero(at >= n - 2)
        shift = np.repeat(np.arange(len(self.counts)), self.counts)[on] + 1  # starts before the token
        return on, tv.gram(ext, n)[on + shift - (n - 1)]


def _ask(n: int, buckets: int):
    def run(row):
        c = _Chunk(row)
        if n == 1:
            count = np.bincount(c.codes[c.train], minlength=len(c.keys))
            return [asks(c.number, c.keys, count, buckets)]
        on, h = c.grams(n)
        order = np.argsort(h)
        h = h[order]
        if not len(h):
            return []
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return [asks(c.number, h[at], np.add.reduceat(c.train[on][order].astype(np.int64), at), buckets)]

    return map_rows(run)


@dataclass(frozen=True)
class Counts:
    """What the whole corpus says: training tokens, their distinct words, training texts, the discount and m."""

    n_words: int
    n_types: int
    n_texts: int
    discount: float
    strength: float

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts; a word never seen has its part of the discounted mass."""
        return np.where(count > 0, count - self.discount, self.discount) / self.n_words


@dataclass(frozen=True)
class Automaton:
    """States are numbers, the root 0. An arc is found by its key, state * words + word; a state without one fails over."""

    words: int
    keys: np.ndarray
    weights: np.ndarray
    next: np.ndarray
    fail: np.ndarray
    fail_weights: np.ndarray
    unseen: float
    begin: int

    def run(self, tokens: np.ndarray, first: np.ndarray, counts: np.ndarray, order: int, lane: int = LANE) -> np.ndarray:
        """The weight of each token; texts begin at `first` and have `counts` tokens."""
        out = np.zeros(len(tokens))
        n = -(-counts // lane)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        warm = np.where(nth > 0, order - 1, 0)  # words that only lead to the state
        at = np.repeat(first, n) + nth * lane - warm
        size = np.minimum(np.repeat(counts, n) - nth * lane, lane) + warm
        rank = np.argsort(-size, kind="stable")
        at, size, warm = at[rank], size[rank], warm[rank]
        state = np.where(warm > 0, 0, self.begin)
        for k in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -k, "left"))
            place = at[:active] + k
            word, now, total = tokens[place], state[:active].copy(), np.zeros(active)
            left = np.arange(active)
            while len(left):
                key = now[left] * self.words + word[left]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[arc] == key
                total[left[hit]] += self.weights[arc[hit]]
                state[left[hit]] = self.next[arc[hit]]
                left = left[~hit]
                root = now[left] == 0
                total[left[root]] += self.unseen
                state[left[root]] = 0
                left = left[~root]
                total[left] += self.fail_weights[now[left]]
                now[left] = self.fail[now[left]]
            scored = k >= warm[:active]
            out[place[scored]] = total[scored]
        return out


def automaton(c: _Chunk, seen: list[np.ndarray], corpus: Counts) -> Automaton:
    """The states and arcs that a chunk's texts can reach. seen: for orders 1, 2, ... the training counts of the chunk's distinct n-grams, by hash."""
    m, order = corpus.strength, len(seen)
    is_end = c.keys == np.uint64(_END)
    count = seen[0]
    p = corpus.unigram(count)
    live = (count > 0) & ~is_end & (order > 1)
    state_of = np.where(live, np.cumsum(live), 0)  # of each word as a context; 0: none
    n_states = int(live.sum()) + 2
    begin = n_states - 1 if order > 1 else 0  # the start of a text
    fail, fail_weights = [np.zeros(n_states, np.int64)], [np.r_[0.0, np.log10(m / (count[live] + m)), np.log10(m / (corpus.n_texts + m))]]
    on_root = np.flatnonzero(count > 0)
    keys, weights, onward = [on_root], [np.log10(p[on_root])], [state_of[on_root]]
    gram_at, full = c.codes.astype(np.int64), np.arange(len(c.codes))  # the (n-1)-gram that ends at each token of `full`
    for n in range(2, order + 1):
        on, h = c.grams(n)
        values, _ = distinct(h)
        own = np.searchsorted(values, h)
        one = np.empty(len(values), np.int64)
        one[own[::-1]] = np.arange(len(h))[::-1]  # a token that ends each n-gram
        token = on[one]
        where = np.full(len(c.codes), -1, np.int64)
        where[full] = gram_at
        suffix = where[token]
        starts = np.zeros(len(c.codes), bool)
        starts[c.first] = True
        before = np.where(starts[token], -1, where[np.maximum(token - 1, 0)])  # -1: the start of a text, for n = 2
        c_before = np.where(before < 0, corpus.n_texts, count[before])
        from_state = np.where(before < 0, begin, state_of[before])
        new = seen[n - 1]
        p = (new + m * p[suffix]) / (c_before + m)
        arc = np.flatnonzero(new > 0)
        keys.append(from_state[arc] * len(c.keys) + c.codes[token[arc]])
        weights.append(np.log10(p[arc]))
        if n < order:
            live = (new > 0) & ~is_end[c.codes[token]]
            old, state_of = state_of, np.where(live, n_states + np.cumsum(live) - 1, 0)
            fail.append(old[suffix[live]])
            fail_weights.append(np.log10(m / (new[live] + m)))
            n_states += int(live.sum())
            onward.append(state_of[arc])
        else:
            onward.append(state_of[suffix[arc]])
        gram_at, full, count = own, on, new
    key = np.concatenate(keys)
    rank = np.argsort(key)
    unseen = float(np.log10(corpus.unigram(np.zeros(1))[0]))
    return Automaton(len(c.keys), key[rank], np.concatenate(weights)[rank], np.concatenate(onward)[rank], np.concatenate(fail), np.concatenate(fail_weights), unseen, begin)


def score(docs: DataFrame, held_out: Column, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Rows for which held_out is true are scored but not learnt from; null counts as false.
    Null texts count as empty and have the end token alone. Repeated and null ids are rows
    of their own. Without training texts every score is 0. base_score adds one to every
    count of a unigram model. Columns other than doc_id, text and those that held_out
    reads are ignored. A very long text is scored whole and makes a chunk of its own size.
    """
    rows = texts_of(docs.withColumn("_held", F.coalesce(held_out, F.lit(False))), "doc_id", "_held").withColumnRenamed("_held", "held")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    with tidy(docs.sparkSession):  # the n-grams of one order at a time are on disk
        chunks = saved(rows.mapInArrow(_chunks, _CHUNKS), bucket="chunk", buckets=buckets_of(rows))
        size = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_texts", "n_keys"))).first()
        asked = [tally(dealt(chunks.mapInArrow(_ask(1, buckets_for(size.n_keys)), TALLY_IN), buckets_for(size.n_keys)))]
        for n in range(2, order + 1):
            asked.append(tally(dealt(chunks.mapInArrow(_ask(n, buckets_for(size.n_tokens)), TALLY_IN), buckets_for(size.n_tokens))))
    types, once, twice = about(asked[0])
    discount = once / (once + 2 * twice) if once and twice else 0.5
    joined = chunks
    for n, t in enumerate(asked, 1):
        joined = joined.join(answers(t, f"totals{n}"), "chunk", "left")
    n_words, n_texts = int(size.n_train), int(size.n_texts)

    corpus = Counts(n_words, types, n_texts, discount, strength)

    def run(row):
        c = _Chunk(row)
        seen = [totals(row.column(f"totals{n}")[0].as_py()) for n in range(1, order + 1)]
        first = seen[0][c.codes]
        logs = automaton(c, seen, corpus).run(c.codes.astype(np.int64), c.first, c.counts, order) if n_words else np.zeros(len(first))
        base = np.log10((first + 1) / (n_words + types + 1))
        add = lambda x: np.add.reduceat(x, c.first) if len(c.first) else np.zeros(0, x.dtype)
        ids = pa.array(tv.unpack(row.column("ids")[0].as_py(), np.int64), mask=tv.unpack(row.column("no_id")[0].as_py(), np.uint8).astype(bool))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(c.held), pa.array(c.counts), pa.array(add((first > 0).astype(np.int64))), pa.array(np.full(len(c.counts), n_words, np.int64)), pa.array(add(base)), pa.array(add(logs))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return joined.mapInArrow(map_rows(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; rows whose crc32(doc_id) mod 7 is 2 are held out of the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
