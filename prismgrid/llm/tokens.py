"""Token ids of a corpus in compressed shards, each a wavelet matrix.

A shard holds the ids of consecutive documents. Bit plane p of the wavelet matrix (Claude,
Navarro and Ordonez, 2015) has bit p of every id, most significant first; after each plane
the ids are split stably, zeros before ones. With a rank directory over the planes this
gives the id at a place, the number of an id's occurrences and the place of its k-th
occurrence from one file, without writing the ids out.

File format (little-endian): "PGWM", version u8, planes u8, reserved u16, ids u64,
documents u64; then fields of u64 length + bytes: packed, the document ids (i64), nulls among
them (u8) and tokens a document (u64); as they are, for each plane its bits and its rank
directory (ones before every 512 bits, u32), each from a multiple of eight bytes, so that a
file that is mapped into memory is read only where an access looks; last the CRC-32 of all
before it.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import saved, texts_of

MAGIC, STEP = b"PGWM", 512
#: Ids in a shard, about; words whose ids a worker remembers.
SHARD, REMEMBER = 4_000_000, 1_500_000
END = 2


class BitPlane:
    """Bits with rank in constant time and select by a search of the directory."""

    def __init__(self, packed: np.ndarray, n: int, ranks: np.ndarray | None = None):
        self.packed, self.n = packed, n
        if ranks is None:
            full = np.zeros(-(-n // STEP) * (STEP // 8), np.uint8)
            full[: len(packed)] = packed
            ones = np.bitwise_count(full).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        self.ranks = ranks

    @property
    def zeros(self) -> int:
        return self.n - int(self.ranks[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def get(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        b = i // STEP
        part = self.packed[b * (STEP // 8) : (i + 7) // 8]
        return int(self.ranks[b]) + int(np.unpackbits(part, count=i - b * STEP).sum()) if i > b * STEP else int(self.ranks[b])

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        before = self.ranks.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * STEP, self.n) - before
        b = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.packed[b * (STEP // 8) : (b + 1) * (STEP // 8)], count=min(STEP, self.n - b * STEP))
        return b * STEP + int(np.flatnonzero(part == bit)[k - int(before[b])])


class WaveletMatrix:
    """A sequence of ids: access, rank, select, and all ids at once."""

    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for p in range(width - 1, -1, -1):
            bit = (a & a.dtype.type(1 << p)).astype(bool)
            planes.append(BitPlane(np.packbits(bit), len(a)))
            a = np.concatenate([a[~bit], a[bit]])
        return cls(planes, len(ids))

    def ids(self) -> np.ndarray:
        """The whole sequence: the splits undone from the last plane to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for p, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            out = np.empty(self.n, kind)
            out[~bit] = a[: plane.zeros]
            out[bit] = a[plane.zeros :] | kind(1 << p)
            a = out
        return a

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit = plane.get(i)
            value = value << 1 | bit
            i = plane.zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        a = 0
        for p, plane in enumerate(self.planes):
            bit = value >> (len(self.planes) - 1 - p) & 1
            a, i = (plane.rank(bit, x) + (plane.zeros if bit else 0) for x in (a, i))
        return a, i

    def rank(self, value: int, i: int | None = None) -> int:
        """Occurrences of an id among the first i (all)."""
        if value < 0 or value >> len(self.planes):
            return 0
        a, b = self._range(value, self.n if i is None else i)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.rank(value):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for p in range(len(self.planes) - 1, -1, -1):
            plane, bit = self.planes[p], value >> (len(self.planes) - 1 - p) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


def write_shard(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file from the documents' ids and token counts and all their token ids."""
    m = WaveletMatrix.build(ids)
    nulls = np.asarray(doc_ids.is_null()).astype(np.uint8)
    fields = [doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nulls, counts.astype(np.uint64)]
    blobs = [tv.pack(f) for f in fields] + [x.tobytes() for plane in m.planes for x in (plane.packed, plane.ranks.astype("<u4"))]
    out = bytearray(MAGIC + bytes([2, len(m.planes), 0, 0]) + len(ids).to_bytes(8, "little") + len(counts).to_bytes(8, "little"))
    for blob in blobs:
        out += len(blob).to_bytes(8, "little") + blob + bytes(-len(blob) % 8)
    return bytes(out + zlib.crc32(out).to_bytes(4, "little"))


def read_shard(blob, check: bool = True) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Documents' ids, token counts and the wavelet matrix of a shard file (bytes, or a file mapped into memory).

    The planes are views of the file. check: compare the checksum, which reads all of it.
    """
    blob = memoryview(blob)
    if blob[:4] != MAGIC or blob[4] != 2 or check and zlib.crc32(blob[:-4]) != int.from_bytes(blob[-4:], "little"):
        raise ValueError("not a shard, or damaged")
    n, at = int.from_bytes(blob[8:16], "little"), 24

    def field() -> memoryview:
        nonlocal at
        a, size = at + 8, int.from_bytes(blob[at : at + 8], "little")
        at = a + size + -size % 8
        return blob[a : a + size]

    ids, nulls, counts = (tv.unpack(bytes(field()), kind) for kind in (np.int64, np.uint8, np.uint64))
    planes = []
    for _ in range(blob[5]):
        bits = np.frombuffer(field(), np.uint8)
        planes.append(BitPlane(bits, n, np.frombuffer(field(), "<u4")))
    return pa.array(ids, mask=nulls.astype(bool)), counts.astype(np.int64), WaveletMatrix(planes, n)


# Marks that the tokenizer's pattern parts from a letter or digit before them, whatever follows.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%&*#$|+=/)]}")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _pieces(texts: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is encoded once: words, the marks at a word's end apart, ASCII case folded as the tokenizer does.

    Returns the words, the pieces' starts, ends and two hashes, and each text's first piece. Texts
    that may hold a special token keep their words and case whole.
    """
    w = tv.split(texts, hashed=False)
    if b"<|" in w.data.tobytes():
        return w, w.starts, w.ends, *(tv.word_hashes(w.data, w.starts, w.ends, False, seed) for seed in (2, 3)), w.first
    core = w.ends.copy()
    for _ in range(8):
        more = _TAIL[w.data[core - 1]] & (core - 1 > w.starts)
        if not more.any():
            break
        core -= more
    cut = (core < w.ends) & _ALNUM[w.data[core - 1]]
    starts = np.insert(w.starts, np.flatnonzero(cut) + 1, core[cut])
    n = np.concatenate([[0], np.cumsum(cut)])
    ends = np.insert(w.ends, np.flatnonzero(cut), core[cut])
    return w, starts, ends, *(tv.word_hashes(w.data, starts, ends, True, seed) for seed in (0, 1)), w.first + n[w.first]


class Encoder:
    """Ids of texts by a word-bounded tokenizer, each distinct word encoded once and remembered.

    The tokenizer must drop white space and look at nothing beyond it, so that a text's ids
    are its words' ids in order; ASCII white space separates words here. A word is known by
    a hash and confirmed by a second one, which up to eight bytes stands for the bytes
    themselves; a word that is not confirmed is encoded by itself and not remembered.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.plain, self.last = _plain(spec)
        self._forget()

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """The worker's own for this tokenizer."""
        if spec not in cls._made:
            cls._made[spec] = cls(spec)
        return cls._made[spec]

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size, self.second = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.store = np.zeros(0, np.uint16 if self.small else np.uint32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        kind = self.store.dtype
        parts, size = [], np.zeros(len(words), np.int64)
        # lower case may add marks (of a dotted capital I) and depends on the place (of a capital sigma)
        low = [x.lower() if x.isascii() else unicodedata.normalize("NFC", x).lower() for x in words]
        letters = np.array([self.plain is not None and x.isalpha() and "\u03c2" not in x for x in low], bool)
        if letters.any():
            own = [x for x, y in zip(low, letters.tolist(), strict=True) if y]
            # some words at a time: the library holds a hundred bytes and more for each token
            some = (" ".join(own[i : i + 4096]) for i in range(0, len(own), 4096))
            flat = np.concatenate([np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind) for text in some])
            stop = np.flatnonzero(self.last[flat]) + 1
            if len(stop) == len(own):
                size[letters] = np.diff(stop, prepend=0)
                parts.append(flat)
            else:
                letters[:] = False
        rest = np.flatnonzero(~letters)
        if len(rest):
            ids = [e.ids for i in range(0, len(rest), 4096) for e in self.tokenizer.encode_batch_fast([words[j] for j in rest[i : i + 4096]], add_special_tokens=False)]
            size[rest] = [len(x) for x in ids]
            parts.append(np.array([x for one in ids for x in one], kind))
        # the letters' ids stand before the others': put them into the words' order
        flat = np.concatenate(parts)
        order = np.concatenate([np.flatnonzero(letters), rest])
        at = np.empty(len(words), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return flat[_ranges(at, size)], size

    def _learn(self, words: list[str], hashes: np.ndarray, second: np.ndarray) -> None:
        ids, size = self._ids(words)
        where = np.searchsorted(self.known, hashes)
        self.place = np.insert(self.place, where, np.arange(len(self.start), len(self.start) + len(size), dtype=np.int32))
        self.known = np.insert(self.known, where, hashes)
        self.start = np.concatenate([self.start, len(self.store) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.second = np.concatenate([self.second, second])
        self.store = np.concatenate([self.store, ids])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes; -1: not known."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.place[at], -1)

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with `end` after it; how many each text has)."""
        w, starts, ends, hashes, second, first_piece = _pieces(texts)
        raw = w.data.tobytes()
        words = lambda at: [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        code, seen = pd.factorize(hashes)
        place = self._find(seen)
        new = np.flatnonzero(place < 0)
        if len(self.start) + len(new) > REMEMBER:
            self._forget()
            new = np.arange(len(seen))
        if len(new):
            new = new[np.argsort(seen[new])]
            first = np.empty(len(seen), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            self._learn(words(first[new]), seen[new], second[first[new]])
            place = self._find(seen)
        own = place[code] if len(code) else np.zeros(0, np.int64)
        start, size, store = self.start, self.size, self.store
        other = np.flatnonzero(self.second[own] != second)
        if len(other):  # another word with the same hash
            more, n = self._ids(words(other))
            own[other] = len(start) + np.arange(len(other))
            start, size, store = np.concatenate([start, len(store) + np.cumsum(n) - n]), np.concatenate([size, n.astype(np.int32)]), np.concatenate([store, more])
        # the end is one more word, behind each text's own
        order = np.insert(own, first_piece[1:], len(start))
        start, size = np.append(start, len(store)), np.append(size, np.int32(1))
        n = size[order].astype(np.int64)
        ids = np.append(store, store.dtype.type(end))[_ranges(start[order], n)]
        stop = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(stop[first_piece + np.arange(len(first_piece))])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


# How the tokenizer must normalise and part words for the short way of _plain().
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _plain(spec: str):
    """The same model for words of letters alone, which need no further normalising or parting.

    Returns it and, for each id, whether it ends a word: many words can then be encoded as
    one text and told apart. (None, None) for tokenizers that are built in another way.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    j = json.loads(spec)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    suffix = j["model"].get("end_of_word_suffix")
    if not suffix or j.get("normalizer") != _NORMAL or len(steps) != 2 or steps[0].get("pattern") != {"Regex": _PARTS} or steps[1].get("type") != "ByteLevel" or steps[1].get("add_prefix_space"):
        return None, None
    t = Tokenizer.from_str(spec)
    t.normalizer = None
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(t.get_vocab_size(), bool)
    for word, i in j["model"]["vocab"].items():
        last[i] = word.endswith(suffix)
    return t, last


_SHARDS = "part int, seq int, n_tokens long, file binary"


def write(docs: DataFrame, tokenizer: str, end: int = END, shard: int = SHARD, order: str = "doc_id", partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Encodes all texts and writes the shard files, in ascending `order`; returns their table.

    path: a folder for them that stays; without it they are in the shared folder while the
    driver runs.

    docs: doc_id, text and `order`; other columns are ignored. tokenizer: the path of a
    tokenizers file. Null texts count as empty and have the end id alone; rows of the same
    order value are sorted by their text, null ids come first. Shards are numbered by
    partition and within it; an empty table has none. A very long text is encoded whole and
    makes a shard of its own size.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.dumps(json.load(f))
    held = spark.sparkContext.broadcast(spec)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.col(order).alias("_order"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "_order").sortWithinPartitions("_order", "text").select("doc_id", "text")

    def run(batches):
        coder, part, seq = Encoder.of(held.value), TaskContext.get().partitionId(), 0
        held_ids: list[pa.Array] = []
        held_counts: list[np.ndarray] = []
        held_tokens: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal seq
            ids = pa.concat_arrays(held_ids)
            tokens = np.concatenate(held_tokens)
            file = write_shard(ids, np.concatenate(held_counts), tokens)
            for x in (held_ids, held_counts, held_tokens):
                x.clear()
            seq += 1
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq - 1], pa.int32()), "n_tokens": pa.array([len(tokens)], pa.int64()), "file": pa.array([file], pa.binary())})

        for batch in batches:
            for piece in tv.slices(batch, most=min(tv.SLICE_BYTES, 4 * shard)):
                tokens, counts = coder.encode(piece.column("text"), end)
                held_ids.append(piece.column("doc_id").cast(pa.int64()))
                held_counts.append(counts)
                held_tokens.append(tokens)
                if sum(map(len, held_tokens)) >= shard:
                    yield out()
        if held_ids:
            yield out()
        tv.give_back()

    files = rows.mapInArrow(run, _SHARDS)
    if path is None:
        return saved(files)
    files.write.parquet(path)
    return spark.read.schema(_SHARDS).parquet(path)


_DOCS = "doc_id long, part int, seq int, nr long, start long, n_tokens long, ids_crc32 long"


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc_ids, counts, matrix = read_shard(row.column("file")[0].as_py())
                ids = matrix.ids().astype("<u4")
                stop = np.cumsum(counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(np.full(n, row.column("part")[0].as_py()), pa.int32()), pa.array(np.full(n, row.column("seq")[0].as_py()), pa.int32()), pa.array(np.arange(n)), pa.array(stop - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "nr", "start", "n_tokens", "ids_crc32"],
                )
        tv.give_back()

    docs = shards.select("part", "seq", "file").mapInArrow(run, _DOCS)
    # where each shard begins: sums over the partitions (a row each), then over each one's shards
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("p_start"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("s_start")).join(parts, "part")
    begin = begin.select("part", "seq", (F.col("p_start") + F.col("s_start")).alias("before"))
    return docs.join(begin, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the shards, read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, str(public_tokenizers.path("word_bpe_49k.json"))))
