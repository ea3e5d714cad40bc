"""Vectorised text primitives shared by the Arrow operators: blocks of UTF-8 bytes, word boundaries, 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for every byte, and the odd base of the positional polynomial.
BYTE_KEY = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
GRAM_KEY = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into row ranges of about `size` text bytes (a longer text stands alone) so that temporaries stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Words:
    """The lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a block: 64-bit hash, document, and byte range of each."""

    __slots__ = ("bytes", "doc", "end", "hash", "n_docs", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        self.bytes = low = LOWER[data]
        n = len(low)
        gap = SPACE[low]
        before = np.ones(n + 1, dtype=bool)
        before[1:] = gap
        before[offsets] = True
        self.start = np.flatnonzero(~gap & before[:-1])
        after = np.ones(n + 1, dtype=bool)
        after[:-1] = gap
        after[offsets] = True
        self.end = np.flatnonzero(~gap & after[1:]) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = range_hash(low, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for ranges that are in order and do not overlap (none empty)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    where = within + np.repeat(start, length)
    value = BYTE_KEY[data[where]] * powers(int(length.max()))[within]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


def word_grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k words; a document with 1 to k-1 words has one gram, its whole sequence."""
    n = len(words.hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        docs, grams = [], []
        if n >= k:
            ok = words.doc[: n - k + 1] == words.doc[k - 1 :]
            g = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                g += words.hash[j : n - k + 1 + j] * GRAM_KEY[j]
            docs.append(words.doc[: n - k + 1][ok])
            grams.append(mix(g[ok]))
        counts = words.counts()
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            own = words.hash[np.searchsorted(words.doc, d) : np.searchsorted(words.doc, d, side="right")]
            docs.append(np.array([d]))
            grams.append(mix(np.array([int((own * GRAM_KEY[: len(own)]).sum(dtype=np.uint64)) + len(own) & (2**64 - 1)], dtype=np.uint64)))
        doc, gram = np.concatenate(docs), np.concatenate(grams)
        order = np.argsort(doc, kind="stable")
        return doc[order], gram[order]


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and several stand idle beside the one at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary(rows: list) -> pa.Array:
    return pa.array([None if r is None else r.tobytes() for r in rows], type=pa.binary())
