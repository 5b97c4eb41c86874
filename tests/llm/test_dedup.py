import hashlib
import random
from collections import Counter

import pytest

from prismgrid.llm import neardup, repeats

from .conftest import changed, prose, words


def removed(texts, n):
    """Which words of each text go, by definition."""
    toks = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in toks for k in range(len(w) - n + 1))
    out = []
    for w in toks:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out.append((w, gone))
    return out


@pytest.mark.parametrize("n", [1, 3, 7, 35])
def test_repeats_by_definition(spark, odd, odd_texts, n):
    got = Counter()
    for r in repeats.remove_repeats(odd, n).collect():
        got[r.doc_id, r.n_words, r.n_removed, r.kept, tuple((s.start, s.stop) for s in r.removed)] += 1
    want = Counter()
    for (i, _), (w, gone) in zip(odd_texts, removed([t for _, t in odd_texts], n), strict=True):
        edges = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), tuple(zip(edges[::2], edges[1::2], strict=True))] += 1
    assert got == want


def test_repeats_within_one_text(spark):
    rng = random.Random(3)
    p = prose(rng, 40, 10**6)
    texts = [f"{p} a b c {p}", "k " * 60, "k " * 34]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()}
    assert got == {0: 80, 1: 60, 2: 0}


def test_words_that_cancel_out_are_told_apart(spark):
    """Thue-Morse words, whose polynomial hashes are equal modulo any power of two."""
    one, two = ("".join(x[i.bit_count() & 1] for i in range(2048)) for x in ("ab", "ba"))
    rng = random.Random(12)
    rest = prose(rng, 40, 10**6)
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()} == {1: 40, 2: 40, 3: 0, 4: 0}
    found = neardup.groups(df, words=3, percent=100)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_the_levels_end_when_nothing_repeats(spark, monkeypatch):
    rng = random.Random(5)
    asked = []
    monkeypatch.setattr(repeats, "tally", lambda df, real=repeats.tally: asked.append(1) or real(df))
    df = spark.createDataFrame([(i, prose(rng, 60, 10**7)) for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in repeats.remove_repeats(df).collect()} == {0} and len(asked) == 1


def test_repeats_of_nothing(nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    assert repeats.levels(35) == [9, 18, 35, 35] and repeats.levels(3) == [3, 3]


def test_op2(spark, sf):
    got = repeats.op2_substring_dedup(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    for i, (w, gone) in zip(docs.doc_id, removed(docs.text.tolist(), 35), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert tuple(got.loc[i]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def classes(rows, n, percent):
    """(doc_id, set size, class) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return [(i, len(sets[k]), low.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80), (1, 50)])
def test_classes_by_all_pairs(odd, odd_texts, n, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(odd, n, percent).collect())
    assert got == Counter(classes(odd_texts, n, percent))


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Lists longer than SHORT, compared by their centre and then in blocks."""
    monkeypatch.setattr(neardup, "SHORT", 3)
    monkeypatch.setattr(neardup, "NODES", 16)
    rng = random.Random(9)
    rows = []
    for g in range(2):
        base = prose(rng, 150, 10**6)
        rows += [(1000 * g + i, changed(rng, base, rng.choice([0.01, 0.02, 0.03, 0.04, 0.06, 0.1]))) for i in range(70)]
    rows += [(5000 + i, prose(rng, 100, 10**6)) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(df, 3, 85).collect())
    want = Counter(classes(rows, 3, 85))
    assert got == want
    assert 30 < len({c for _, _, c in want}) < 150


def test_classes_with_short_sketches(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = prose(rng, 400, 10**6)
        rows += [(10 * g + i, changed(rng, base, 0.02)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(df, 3, 85, k=64).collect())
    assert got == Counter(classes(rows, 3, 85))


def test_classes_of_nothing(nothing):
    assert neardup.groups(nothing).count() == 0
    assert neardup.keep_one(nothing).count() == 0


def test_overlap_bounds():
    assert neardup.overlap(10, 80) == 8 and neardup.overlap(1, 85) == 1
    assert neardup.overlap(10**6, 85) < 0.85 * neardup.SKETCH


def test_keep_one(odd, odd_texts):
    out = neardup.keep_one(odd, 5, 80)
    assert out.columns == odd.columns
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    want = Counter()
    seen = set()
    for (i, t), (_, n, c) in zip(odd_texts, classes(odd_texts, 5, 80), strict=True):
        if not n:
            want[i] += 1
        elif i == c and (i, t) not in seen:
            seen.add((i, t))
            want[i] += 1
    assert got == want


def test_op3(spark, sf):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op3_near_dedup(spark, sf).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == Counter((i, n, c, i == c) for i, n, c in classes(docs, 3, 85))
