import math
import time
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismgrid.llm import lm, quality

from .conftest import words


def plain_scores(rows, order, strength):
    """(doc_id, held out, tokens, known, N, base, score) of each row, by definition."""
    toks = [[*words(t, lower=True), None] for _, t in rows]
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [w for w, h in zip(toks, held, strict=True) if not h]
    count = Counter(w for t in train for w in t)
    grams = {n: Counter() for n in range(2, order + 1)}
    for t in train:
        t = ["<s>", *t]
        for n in grams:
            grams[n].update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    total, kinds = sum(count.values()), len(count)
    once, twice = (sum(v == x for v in count.values()) for x in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for (i, _), t, h in zip(rows, toks, held, strict=True):
        score = 0
        for k, w in enumerate(t, 1):
            p = (count[w] - d if count[w] else d) / total
            past = ["<s>", *t]
            for n in range(2, min(order, k + 1) + 1):
                before = tuple(past[k - n + 1 : k])
                ctx = (len(train) if before == ("<s>",) else count[before[0]]) if n == 2 else grams[n - 1][before]
                p = (grams[n][(*before, w)] + strength * p) / (ctx + strength) if ctx else p
            score += math.log10(p)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t)
        out.append((i, h, len(t), sum(count[w] > 0 for w in t), total, round(base, 5), round(score, 5)))
    return out


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_definition(odd, odd_texts, order):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm.score(odd, held_out(), order, 10.0).collect())
    want = Counter(plain_scores(odd_texts, order, 10.0))
    near = lambda c: sorted((str(k[0]), *k[1:5], round(k[5], 3), round(k[6], 3), n) for k, n in c.items())
    assert near(got) == near(want)


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {p.name for d in env.blockManager().diskBlockManager().localDirs() for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_counted_ngrams_do_not_stay_on_disk(spark, odd):
    """The shuffles of the counts go when their totals are saved; the session's settings are as before."""
    odd.count()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    scores = lm.score(odd, held_out())
    end = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not left and spark.conf.get(key, None) == setting
    assert scores.count() == odd.count()


def whole_chunk(texts, held=()):
    """A chunk with all texts, and the counts that the whole corpus would give it."""
    toks = pa.array(texts, pa.string())
    lm_rows = list(lm._chunks(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "held": [k in held for k in range(len(texts))], "text": toks})])))
    return lm._Chunk(lm_rows[0])


def corpus_counts(c, order, strength):
    first = np.bincount(c.codes[c.train], minlength=len(c.keys))
    seen = [first]
    for n in range(2, order + 1):
        on, h = c.grams(n)
        values = np.unique(h)
        seen.append(np.bincount(np.searchsorted(values, h), c.train[on], len(values)).astype(np.int64))
    return seen, lm.Counts(int(c.train.sum()), int((first > 0).sum()), int((~c.held).sum()), 0.4, strength)


@pytest.fixture()
def one_task(monkeypatch):
    monkeypatch.setattr(lm, "chunked", lambda batches, most: enumerate(batches))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_probabilities_sum_to_one(one_task, order):
    """Over the words seen, the end and as many distinct unseen words as the model reckons with, in every context."""
    vocabulary = [f"w{i}" for i in range(6)]
    unseen = [f"new{i}" for i in range(7)]  # six words and the end are seen
    train = ["w0 w1 w2 w3", "w0 w1 w2 w4 w5", "w2 w0 w1 w2 w3 w3", "w5"]
    for history in ("", "w0", "w0 w1", "w1 w2", "w4 new0", "w3 w3 w3"):
        texts = [*train, *(f"{history} {w}" for w in [*vocabulary, *unseen]), history]
        c = whole_chunk(texts, held=range(len(train), len(texts)))
        seen, corpus = corpus_counts(c, order, 2.0)
        logs = lm.automaton(c, seen, corpus).run(c.codes.astype(np.int64), c.first, c.counts, order)
        place = len(history.split())
        last = [c.first[k] + place for k in range(len(train), len(texts))]
        assert np.isclose((10 ** logs[last]).sum(), 1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lanes_make_no_difference(one_task, order):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)) for n in (0, 1, 2, 3, 40, 700, 1500)]
    c = whole_chunk(texts, held=(4, 6))
    seen, corpus = corpus_counts(c, order, 2.0)
    a = lm.automaton(c, seen, corpus)
    run = lambda lane: a.run(c.codes.astype(np.int64), c.first, c.counts, order, lane)
    assert np.array_equal(run(10**6), run(order - 1)) and np.array_equal(run(10**6), run(64))
    # failure arcs lead to shorter contexts and end at the root
    state = np.arange(len(a.fail))
    for _ in range(order):
        state = a.fail[state]
    assert not state.any() and (a.fail_weights[1:] < 0).all()


def test_scores_of_nothing(nothing, odd):
    assert lm.score(nothing, held_out()).count() == 0
    r = lm.score(odd, F.lit(True)).agg(F.max("train_tokens"), F.max(F.abs("score"))).first()
    assert tuple(r) == (0, 0.0)


def test_op4(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm.op4_lm_scores(spark, sf).collect()}
    for i, h, n, known, total, base, score in plain_scores(docs, lm.ORDER, lm.STRENGTH):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert abs(r.base_score - base) < 1e-4 and abs(r.score - score) < 1e-4
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the gain does not come from words never seen: texts whose every word is known gain too
    known = [r for r in held if r.n_known == r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    try:
        labels = spark.read.parquet(f"{sf}/labels.parquet")
    except Exception:  # noqa: BLE001
        pytest.skip("no test data")
    got = quality.op6_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    both = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.95
    assert ((both.score >= 0) & (both.score <= 1)).all()


def test_quality_is_the_same_again(spark, sf):
    a, b = (sorted((r.doc_id, r.score) for r in quality.op6_quality(spark, sf).collect()) for _ in range(2))
    assert a == b


def test_features():
    text, feature = quality.features(pa.array(["a b A!", "", None, " ", "x" * 9]))
    assert set(text) == {0, 1, 2, 3, 4} and (np.diff(text) >= 0).all()
    assert (feature[text == 1] == feature[text == 2]).all() and (feature[text == 1] == feature[text == 3]).all()
    assert len(quality.features(pa.array([], pa.string()))[0]) == 0


def test_fit_and_descent():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 30) + (400 if i % 3 else 0)) for i in range(300)]
    model = quality.fit(sets, np.array([int(i % 3 > 0) for i in range(300)]))
    margin = [model.margins(np.zeros(len(s), int), s, 1)[0] for s in sets]
    assert all((m > 0) == (i % 3 > 0) for i, m in enumerate(margin))


def test_quality_without_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for labels in (none, one):
        assert quality.rejects(spark, odd, labels).count() == odd.count()
        assert quality.rejects(spark, nothing, labels).count() == 0
    two = spark.createDataFrame([(i, i % 2) for i in range(1, 18)] + [(4, 1)], "doc_id long, quality int")
    out = quality.rejects(spark, odd, two)
    assert out.columns == odd.columns and out.count() <= odd.count()
    scored = quality.score(odd.select("doc_id", "text"), quality.train(odd, two), ["doc_id"], "doc_id long")
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
