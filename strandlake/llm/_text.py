"""Words and shingles of whole Arrow columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one slice holds at most, unless a single document is longer.
SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) for runs of rows of about limit bytes; nulls read as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no document boundary cuts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _chain(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a sequence that goes on with w. Feeding w forward keeps the step from being solved for w."""
    return mix(h * np.uint64(0xA24BAED4963EE407) + w) ^ mix(w + np.uint64(0x9E3779B97F4A7C15))


#: Bytes of the longest span that is hashed by blocks of eight; longer ones go through BLAKE2.
BLOCKED = 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    A span of up to seven bytes is put, with its length, through a bijection, so
    no two of them collide; up to BLOCKED bytes its blocks of eight are chained;
    longer ones go through BLAKE2.
    """
    size = ends - starts
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next bytes from at, eight at most, as a number."""
        unused = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
        return eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)

    out = np.empty(len(size), np.uint64)
    at = np.flatnonzero((size > 0) & (size <= 7))
    out[at] = mix(mix(block(starts[at], size[at]) | size[at].astype(np.uint64) << np.uint64(56)) + np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero((size > 7) & (size <= BLOCKED))
    h = mix(eight[starts[at]] ^ mix(size[at].astype(np.uint64)))
    for done in range(8, BLOCKED, 8):
        more = np.flatnonzero(size[at] > done)
        h[more] = _chain(h[more], block(starts[at[more]] + done, size[at[more]] - done))
    out[at] = mix(h)
    at = np.flatnonzero(size > BLOCKED)
    if len(at):
        raw = data.tobytes()
        out[at] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word: runs without space, tab, newline, \\v, \\f or \\r; A-Z lower-cased."""
    data = LOWER[data]
    starts, ends = spans(~WHITE[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, one after the other, and their bounds.

    A document with 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    w, doc = words(data, offsets)
    n_docs = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    full = w.copy()
    ok = np.ones(len(w), bool)
    for t in range(1, k):
        n = max(0, len(w) - t)
        nxt = np.zeros_like(w)
        nxt[:n] = w[t:]
        full = _chain(full, nxt)
        ok[n:] = False
        ok[:n] &= doc[t:] == doc[:n]
    size = np.diff(bounds)
    for d in np.flatnonzero((size > 0) & (size < k)):
        h = w[bounds[d] : bounds[d] + 1] + np.uint64(size[d])
        for i in range(bounds[d] + 1, bounds[d + 1]):
            h = _chain(h, w[i : i + 1])
        full[bounds[d]] = h[0]
        ok[bounds[d]] = True
    h, doc = full[ok], doc[ok]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))
