import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismgrid.llm import common
from prismgrid.llm import textvec as tv

from .conftest import words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢\t\n\x0b \x1c", max_size=30)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    for lower in (False, True):
        w = tv.split(pa.array(texts, pa.string()), lower)
        want = [words(t, lower) for t in texts]
        assert w.counts.tolist() == [len(x) for x in want]
        names = {}
        for word, h in zip((x for one in want for x in one), w.hashes.tolist(), strict=True):
            assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


def thue_morse(n, letters="ab"):
    """Words whose letters cancel out in any polynomial hash modulo a power of two."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("seed", [0, 1])
def test_structured_words_do_not_collide(seed):
    n = [8, 9, 16, 63, 64, 65, 128, 512, 1024, 2048, 4096]
    texts = [thue_morse(k, x) for k in n for x in ("ab", "ba")]
    texts += ["a" * k for k in range(1, 200)] + ["a" * k + "b" + "a" * (150 - k) for k in range(150)]
    texts += ["x" * 7 + "\0", "x" * 7, "\0", "\0\0", "abcdefgh" + "ijklmnop", "ijklmnop" + "abcdefgh"]
    w = tv.split(pa.array(texts))
    assert len(set((w.again(seed) if seed else w.hashes).tolist())) == len(set(texts))


def test_long_words_hash_alike_anywhere():
    long = "q" * 600_000
    w = tv.split(pa.array([long, "a " + long + " b", long[:-1], "c"]))
    assert w.hashes[0] == w.hashes[2] and len(set(w.hashes.tolist())) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 35])
def test_grams_are_equal_if_and_only_if_words_are(n):
    rng = random.Random(n)
    seq = [rng.randrange(3) for _ in range(400)]
    h = tv.gram(tv.fmix(np.array(seq, np.uint64)), n)
    names = {}
    for i, x in enumerate(h.tolist()):
        assert names.setdefault(tuple(seq[i : i + n]), x) == x
    assert len(set(names.values())) == len(names)


def test_shingle_sets():
    texts = ["a b c d", "A b C d a b c", "a b", "b a", "a", "", None, "a b c"]
    w = tv.split(pa.array(texts), lower=True)
    text, h = tv.shingle_sets(w, 3)
    size = np.bincount(text, minlength=len(texts)).tolist()
    assert size == [2, 4, 1, 1, 1, 0, 0, 1]
    assert len(set(h[np.isin(text, [2, 3, 4])].tolist())) == 3
    assert all((np.diff(h[text == t].astype(float)) > 0).all() for t in range(8))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    a = np.array(sorted(values), np.uint64)
    assert (tv.unpack_sorted(tv.pack_sorted(a)) == a).all()
    assert (tv.unpack(tv.pack(a), np.uint64) == a).all()


def test_slices_keep_rows_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 100, 3, 3, 3, 50)], "n": list(range(7))})
    parts = list(tv.slices(batch, most=10))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6]]


def test_tally(spark):
    rng = np.random.default_rng(1)
    chunks = {c: common.distinct(rng.integers(0, 2**63, 50, dtype=np.uint64).repeat(rng.integers(1, 3, 50)) if c % 2 else np.arange(40, dtype=np.uint64) << np.uint64(58)) for c in range(6)}

    def emit(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                yield common.asks(c, *chunks[c], 8)

    asked = spark.range(6).mapInArrow(emit, common.TALLY_IN)
    total = {}
    for keys, counts in chunks.values():
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            total[k] = total.get(k, 0) + n
    told = common.tally(asked)
    got = {r.chunk: common.totals(r.t).tolist() for r in common.answers(told, "t").collect()}
    assert got == {c: [total[k] for k in keys.tolist()] for c, (keys, _) in chunks.items()}
    assert common.about(told) == tuple(sum(f(v) for v in total.values()) for f in (lambda v: v >= 1, lambda v: v == 1, lambda v: v == 2))
    own = {r.chunk: common.totals(r.t).tolist() for r in common.answers(common.owners(asked), "t").collect()}
    first = {}
    for c in sorted(chunks):
        for k in chunks[c][0].tolist():
            first.setdefault(k, c)
    assert own == {c: [int(first[k] == c) for k in keys.tolist()] for c, (keys, _) in chunks.items()}


@pytest.mark.parametrize("each", [10**6, 25])
def test_components(spark, each):
    rng = random.Random(8)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(60)] + [(5, 5)]
    parent = list(range(400))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    name = lambda c: F.lpad(F.col(c).cast("string"), 4, "0").cast("binary")
    df = spark.createDataFrame(edges, "a int, b int").select(name("a").alias("a"), name("b").alias("b"))
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in common.components(df, each=each).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(df.where("1 = 0")).count() == 0


def test_bucket_counts():
    assert common.buckets_for(0) == common.buckets_for(1) > 1 and common.buckets_for(10**9) == math.ceil(10**9 / 10**6)
