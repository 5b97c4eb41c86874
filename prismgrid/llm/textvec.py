"""Vectorised words, word hashes and word windows over Arrow string columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes 0x20 and
0x09-0x0D, which never occur inside a multi-byte UTF-8 sequence. All hashing is done
by numpy over the column's byte buffer: no Python object is made per word.

Nulls count as empty texts; empty texts have no words. Hashes are 64-bit, the same on
every machine and in every run. A very long text, or word, is worked on as a whole: it
takes memory in proportion to its length.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: _FIRST[n] leaves the first n bytes of eight; words of more than _LONG bytes are hashed by BLAKE2b.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64
#: Text bytes that one call works on, so that memory does not follow the batch.
SLICE_BYTES = 1 << 21


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two hashes in order."""
    h = b * U64(0xC2B2AE3D27D4EB4F)
    h += a
    return fmix(h)


@dataclass
class Words:
    """The words of n texts. first[t] is the index of text t's first word; first[n] is their number."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    lower: bool = False

    def again(self, seed: int = 1) -> np.ndarray:
        """Hashes of the words that are independent of `hashes`."""
        return word_hashes(self.data, self.starts, self.ends, self.lower, seed)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """Indices of the words at which a window of n words of one text starts."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Hash of the bytes from each start to its end; seeds give independent hashes. lower: A-Z as a-z.

    Eight bytes at a time are mixed into the state, which begins with the length, so that
    words of up to eight bytes and the same length never collide. Longer words do so by
    chance alone (1 in 2**64): nothing is linear in the bytes. Words of more than _LONG
    bytes go through a cryptographic hash.
    """
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    size = ends - starts
    out = fmix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD6E8FEB86659FD93 % 2**64 + 1))
    out = fmix(out ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        v = eight[starts[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]
        out[at] = fmix(out[at] ^ v)
        done += 8
        at = at[size[at] > done]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def split(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    """Words and word hashes (if asked for) of a string array; lower: A-Z hash as a-z."""
    data, offsets = buffers(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U64))
    word = ~_SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    hashes = word_hashes(data, starts, ends, lower) if hashed else np.zeros(0, U64)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes, lower)


def gram(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive elements from each position, by doubling; the last n-1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    h, size = hashes, 1
    while 2 * size <= n:
        h, size = pair(h[:-size], h[size:]), 2 * size
    if size < n:  # two overlapping halves fix the whole
        h = pair(h[: len(hashes) - n + 1], h[n - size :])
    return h


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: (text, hash), sorted by both.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    at, of = w.windows(n), w.text_of()
    text, h = of[at], gram(w.hashes, n)[at] if len(at) else np.zeros(0, U64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        short = np.empty(len(few), U64)
        for size in np.unique(w.counts[few]):
            sel = w.counts[few] == size
            acc = np.full(sel.sum(), size, U64)
            for k in range(size):
                acc = pair(acc, w.hashes[w.first[few[sel]] + k])
            short[sel] = acc
        text, h = np.concatenate([text, few]), np.concatenate([h, short])
    order = np.lexsort((h, text)) if len(few) else None
    if order is not None:
        text, h = text[order], h[order]
    else:
        h = segment_sort(h, text, len(w.first) - 1)
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[keep], h[keep]


def segment_sort(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """values sorted within each text (texts are in order)."""
    out, cuts = values.copy(), np.searchsorted(text, np.arange(n + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` text bytes: rows are never cut."""
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers are kept and idle beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---- packing of numbers for shuffles -------------------------------------------------

_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; unpack() needs the type."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, codec=_CODEC, asbytes=True) if len(raw) else b"")


def unpack(blob: bytes, dtype) -> np.ndarray:
    n, dtype = int.from_bytes(blob[:8], "little"), np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(blob[8:], decompressed_size=n * dtype.itemsize, codec=_CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, as differences."""
    return pack(np.diff(values, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, U64), dtype=U64)
