"""Word and n-gram hashes of whole texts with numpy, over Arrow buffers.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f, \\r; ASCII letters are lower-cased.  A word's
64-bit hash is a polynomial over its bytes, taken from running sums, so there is no loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: The same and all ASCII punctuation.
PUNCTUATION = _SEP.copy()
PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_VAL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VAL[65:91] = _VAL[97:123]
_MUL = 0xD1342543DE82EF95
_INV = pow(_MUL, -1, 2**64)
#: Bytes that one step of the hashing takes at a time; its arrays are about 40 times as large.
BLOCK = 1 << 19
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _pow.get(base)
    if got is None or len(got) < n:
        m = max(n, BLOCK + 4096)
        got = np.empty(m, U)
        got[0] = 1
        k = 1
        while k < m:
            step = U(pow(base, k, 2**64))
            j = min(k, m - k)
            got[k : k + j] = got[:j] * step
            k += j
        _pow[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Rows that a batch of chunks() has at most.
CHUNK_ROWS = 4096


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows anew, in batches of about max_bytes of one column (one row at least) and CHUNK_ROWS rows at most, so that memory is bounded."""
    held, size, rows = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_buffers(b.column(column))
        i, n = 0, b.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + max(0, max_bytes - size), "right")) - 1
            j = min(max(j, i + 1 if not held else i), i + CHUNK_ROWS - rows, n)
            if j > i:
                held.append(b.slice(i, j - i))
                size += int(off[j] - off[i])
                rows += j - i
                i = j
            if i < n or size >= max_bytes or rows == CHUNK_ROWS:
                yield _joined(held)
                held, size, rows = [], 0, 0
    if held:
        yield _joined(held)
    release()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay with their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        lo = starts[k]
        j = max(int(np.searchsorted(ends, lo + BLOCK, "right")), k + 1)
        hi = ends[j - 1]
        run = np.zeros(hi - lo + 1, U)
        np.cumsum(_VAL[data[lo:hi]] * _powers(_MUL, hi - lo), out=run[1:])
        s, e = starts[k:j] - lo, ends[k:j] - lo
        out[k:j] = (run[e] - run[s]) * _powers(_INV, hi - lo)[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15)
        k = j
    return mix(out), np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row (also across texts: the caller leaves those out)."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    acc = np.zeros(m, U)
    mul = 1
    for k in range(n):
        mul = mul * 0xA24BAED4963EE407 % 2**64
        acc += words[k : k + m] * U(mul)
    return mix(acc + U(n))


def shingle_sets(words: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, sorted; fewer words are one shingle, no words none."""
    grams = ngram_hashes(words, n)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield ngram_hashes(words[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, U)
