"""Vectorised tokenising of Arrow text columns on their UTF-8 bytes.

A text column is handled in blocks of whole documents of about ``BLOCK`` bytes,
so memory depends on the block and on the longest document, never on the number
of rows in a batch.  Hashes are 64-bit polynomials over random byte values,
finished with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
#: For work that keeps many numbers a byte: a worker holds what a block needed long after its last task.
SMALL_BLOCK = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that start a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = n + (n >> 3) + (1 << 12)
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * up, out=out[1:])
    return out


def prefix_hash_8(data: np.ndarray) -> np.ndarray:
    """Prefix sums over all runs of 8 bytes: ``span_hash`` of [a, b - 7) tells the bytes [a, b), which are 8 at least.

    Every run is mixed first, so texts that bytewise polynomials confuse differ here.
    """
    n = max(0, len(data) - 7)
    up, _ = powers(n)
    runs = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) if n else np.zeros(0, np.uint64)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(runs.astype(np.uint64)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Block:
    """Whole documents lo..hi of a batch: their bytes and where each starts."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return self.hi - self.lo

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    raw, at = column_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def per_document(block: Block, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each document the mask holds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[block.offsets[1:]] - total[block.offsets[:-1]]


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: first[k]:first[k + 1] are the words of document k.
    first: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block) -> Words:
    """Maximal runs of bytes that are not ASCII white space, never across documents."""
    black = ~WHITE[block.data]
    n = len(black)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.ones(n, bool)
    after = np.ones(n, bool)
    if n:
        before[1:] = ~black[:-1]
        after[:-1] = ~black[1:]
        before |= edge[:n]
        after |= edge[1:]
    start = np.flatnonzero(black & before)
    end = np.flatnonzero(black & after) + 1
    return Words(start, end, np.searchsorted(start, block.offsets))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the document of each.

    A document with 1 to k - 1 words has its whole sequence as one window.
    """
    counts = np.diff(first)
    n = len(hashes)
    document = np.repeat(np.arange(len(counts)), counts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n) - first[document]
    left = counts[document] - place
    out = np.zeros(n, np.uint64)
    for j in range(k):
        inside = left > j
        here = np.zeros(n, np.uint64)
        m = max(0, n - j)
        here[:m] = hashes[j:]
        out = np.where(inside, mix(out * _BASE + here + np.uint64(j + 1)), out)
    keep = (left >= k) | ((place == 0) & (counts[document] < k))
    return out[keep], document[keep]


def distinct(keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, key) pairs, ordered by document and then by key."""
    order = np.lexsort((keys, document))
    keys, document = keys[order], document[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
        keys, document = keys[new], document[new]
    return keys, document
