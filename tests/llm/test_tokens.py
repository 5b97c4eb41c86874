import importlib
import json
import mmap
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismgrid.llm import common, tokens


from .test_dedup import classes
from .test_scans import contained

P = pytest.importorskip("public_tokenizers")
FILE = str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def encoded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


ALPHABET = "aBc'sté́ñßΣσİﬁ漢字한١9_.,!?%&*#$|<>-\"() \t\n\x0b\x1c\x85  "


@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=40), st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "It's, he'll; DON'T!?%%%", "x" * 3000])), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    spec = Path(FILE).read_text()
    library = test_ids_are_the_librarys.__dict__.setdefault("t", None) or Tokenizer.from_str(spec)
    test_ids_are_the_librarys.__dict__["t"] = library
    ids, counts = tokens.Encoder.of(spec).encode(pa.array(texts, pa.string()))
    want = [encoded(library, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_a_full_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 20)
    coder = tokens.Encoder(Path(FILE).read_text())
    for k in range(5):
        texts = [" ".join(f"word{k}{i} again." for i in range(30)), "again word00"]
        ids, _ = coder.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in encoded(library, t)]


def test_words_with_one_hash_keep_their_own_ids(library, monkeypatch):
    """The first hash is made nearly useless: the second one tells words apart."""
    real = tokens.tv.word_hashes
    monkeypatch.setattr(tokens.tv, "word_hashes", lambda *a: real(*a) & np.uint64(3) if a[-1] in (0, 2) else real(*a))
    coder = tokens.Encoder(Path(FILE).read_text())
    for k in range(3):
        texts = [" ".join(f"word{k}{i} again, thing" for i in range(30)), "", "again <|endoftext|> word00", None]
        ids, counts = coder.encode(pa.array(texts))
        want = [encoded(library, t) for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_a_mapped_file_is_read_where_it_is_looked_at(tmp_path):
    a = np.random.default_rng(3).integers(0, 50_000, 20_000).astype(np.uint32)
    path = tmp_path / "shard"
    path.write_bytes(tokens.write_shard(pa.array([1], pa.int64()), np.array([len(a)]), a))
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as blob:
        _, _, m = tokens.read_shard(blob, check=False)
        assert all(not p.packed.flags.owndata and not p.ranks.flags.owndata for p in m.planes)
        assert [m.access(i) for i in (0, 777, 19_999)] == a[[0, 777, 19_999]].tolist()
        assert m.rank(int(a[5])) == int((a == a[5]).sum()) and a[m.select(int(a[5]), 0)] == a[5]
        del m


def test_other_tokenizers_take_the_long_way():
    j = json.loads(Path(FILE).read_text())
    j["normalizer"] = None
    assert tokens._plain(json.dumps(j)) == (None, None)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 50_000, 10**6])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    a = np.minimum(rng.geometric(0.01, n) * (top // 100 + 1), top).astype(np.uint32)
    ids = pa.array([5, None] if n else [], pa.int64())
    counts = np.array([n // 2, n - n // 2]) if n else np.zeros(0, int)
    blob = tokens.write_shard(ids, counts, a)
    back, got, m = tokens.read_shard(blob)
    assert back.to_pylist() == ids.to_pylist() and got.tolist() == counts.tolist() and m.ids().tolist() == a.tolist()
    for i in range(0, n, max(1, n // 40)):
        v = int(a[i])
        assert m.access(i) == v and m.rank(v, i) == int((a[:i] == v).sum()) and m.select(v, m.rank(v, i)) == i
    assert m.rank(top + 1) == int((a == top + 1).sum()) and m.rank(1 << 30) == 0
    for bad in (lambda: m.access(n), lambda: m.select(top + 1, 0)):
        with pytest.raises(IndexError):
            bad()
    damaged = bytearray(blob)
    damaged[len(blob) // 2] ^= 1
    with pytest.raises(ValueError):
        tokens.read_shard(bytes(damaged))


@pytest.mark.parametrize("shard", [tokens.SHARD, 300])
def test_round_trip(odd, odd_texts, library, shard):
    got = tokens.read(tokens.write(odd, FILE, shard=shard)).collect()
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, Counter()
    for i, t in rows:
        ids = encoded(library, t)
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want


def test_shards_hold_all_ids(odd, odd_texts, library):
    files = tokens.write(odd, FILE, shard=2000, partitions=1).orderBy("part", "seq").collect()
    assert len(files) > 3
    ids = [x for f in files for x in tokens.read_shard(bytes(f.file))[2].ids().tolist()]
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert ids == [x for _, t in rows for x in encoded(library, t)]
    assert sum(tokens.read_shard(bytes(f.file))[2].rank(2) for f in files) == ids.count(2)


def test_shards_stay_where_they_are_wanted(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    a = sorted(tuple(r) for r in tokens.read(tokens.write(odd.where("doc_id is not null"), FILE, path=path)).collect())
    assert a == sorted(tuple(r) for r in tokens.read(spark.read.parquet(path)).collect())


def test_tokens_of_nothing(nothing):
    assert tokens.read(tokens.write(nothing, FILE)).count() == 0


def test_pipeline_by_stages(spark, library):
    """Each stage against its definition on its own input."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        inputs.append((name, before))
        docs = common.saved(stage(spark, docs, sf))
        assert name == "tokens" or docs.columns == columns
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = set(ids)
            known = [i for i, _, _ in before if i in labels]
            assert sum((i in kept) == bool(labels[i]) for i in known) / len(known) > 0.95
        elif name == "near_dedup":
            assert sorted(ids) == sorted(i for i, n, c in classes([b[:2] for b in before], 5, 80) if not n or i == c)
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hit = {k[0] for k in contained([b[:2] for b in before], items)}
            assert sorted(ids) == sorted(i for i, _, _ in before if i not in hit)
        elif name == "mix":
            assert sorted(ids) == sorted(i for i, _, _ in before)
        else:
            at = 0
            by_id = {r.doc_id: r for r in rows}
            for i, t, _ in before:  # read in stored order: one file, or files in order
                want = encoded(library, t)
                r = by_id[i]
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
                at += len(want)
    assert [n for n, _ in inputs] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    out = corpus_pipeline.run(spark, sf)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in rows)


def test_stored_order_is_the_mixed_order(spark, odd, tmp_path):
    from prismgrid.llm import mixing

    place = {(r.doc_id, r.text): r.position for r in mixing.mix(odd, block=2, keep=("text",)).collect()}
    mixing.in_mixed_order(odd, block=2).write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    once = [r for r in back if sum((b.doc_id, b.text) == (r.doc_id, r.text) for b in back) == 1]
    assert [place[r.doc_id, r.text] for r in once] == sorted(place[r.doc_id, r.text] for r in once)


def test_catalogue():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_the_rest_works_without_this_subpackage(tmp_path):
    import shutil

    root = Path(__file__).parents[2]
    shutil.copytree(root / "prismgrid", tmp_path / "prismgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hdgf_exact' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
