"""The word graph: a k-mer points to the one that follows it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.kmers import _chunks, _column


def _spelled(digits: np.ndarray, letters: np.ndarray) -> pa.Array:
    """Words from rows of letter numbers."""
    flat = np.ascontiguousarray(letters[digits])
    size = flat.shape[1]
    offsets = pa.py_buffer(np.arange(0, flat.size + 1, size, dtype=np.int32))
    return pa.Array.from_buffers(pa.string(), len(flat), [None, offsets, pa.py_buffer(flat)])


def _counted(batch: pa.RecordBatch, at: int, word: int, step: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """(row, src, dst, n) of each distinct pair of words in each row of a column of ASCII sequences; pairs are numbers until they are counted."""
    data, offsets = _column(batch, at)
    letters, digit = np.unique(data, return_inverse=True)
    width = max(2, len(letters))
    if (len(letters) and letters[-1] >= 128) or width ** (2 * word) * max(1, batch.num_rows) >= 1 << 62:
        yield from _plain(batch, at, word, step)
        return
    starts = len(data) - 2 * word + 1
    if starts <= 0:
        return
    code = np.zeros(starts, np.int64)
    for p in range(2 * word):
        code = code * width + digit[p : p + starts]
    place = np.arange(starts)
    row = np.searchsorted(offsets, place, "right") - 1
    ok = (place + 2 * word <= offsets[row + 1]) & ((place - offsets[row]) % step == 0)
    space = width ** (2 * word)
    both, n = np.unique(row[ok] * space + code[ok], return_counts=True)
    digits = both[:, None] // width ** np.arange(2 * word - 1, -1, -1, dtype=np.int64) % width
    yield both // space, _spelled(digits[:, :word], letters), _spelled(digits[:, word:], letters), n.astype(np.int64)


def _plain(batch: pa.RecordBatch, at: int, word: int, step: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """The same for other letters and for words too long to be numbers."""
    for i, seq in enumerate(batch.column(at).to_pylist()):
        pairs: dict[tuple[str, str], int] = {}
        for a in range(0, len(seq or "") - 2 * word + 1, step):
            key = seq[a : a + word], seq[a + word : a + 2 * word]
            pairs[key] = pairs.get(key, 0) + 1
        if pairs:
            src, dst = zip(*pairs)
            yield np.full(len(pairs), i), pa.array(src, pa.string()), pa.array(dst, pa.string()), np.array(list(pairs.values()), np.int64)


def _edges(batches: Iterator[pa.RecordBatch], word: int, step: int) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 64):
        for row, src, dst, n in _counted(batch, 1, word, step):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), src, dst, pa.array(n)], names=["seq_id", "src", "dst", "n"])


def word_edges(seqs: DataFrame, word: int, step: int = 1) -> DataFrame:
    """(seq_id, src, dst, n): how often dst follows src in a row's sequence, over the starts 1, 1 + step, ... at which two words fit; sequences shorter than two words have none."""
    return seqs.select("seq_id", "seq").mapInArrow(partial(_edges, word=word, step=step), "seq_id long, src string, dst string, n long")


def _pairs(batches: Iterator[pa.RecordBatch], word: int, step: int) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows, given on whenever many different pairs have come together."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["src", "dst"]).aggregate([("n", "sum")]).rename_columns(["src", "dst", "n"])

    for batch in _chunks(batches, 512):
        for _, src, dst, n in _counted(batch, 0, word, step):
            held.append(pa.table({"src": src, "dst": dst, "n": pa.array(n)}))
        if sum(t.num_rows for t in held) > 1 << 19:
            held = [summed()]
            if held[0].num_rows > 1 << 18:
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


def adjacency(seqs: DataFrame, word: int, step: int = 1) -> DataFrame:
    """(src, dst, n) of all sequences together, added up in each task before they are shuffled."""
    parts = seqs.select("seq").mapInArrow(partial(_pairs, word=word, step=step), "src string, dst string, n long")
    return parts.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def missing_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The vertices (kmer) that no edge (src, dst) touches."""
    used = edges.select(F.col("src").alias("kmer")).union(edges.select(F.col("dst").alias("kmer"))).distinct()
    return vertices.select("kmer").join(used, "kmer", "left_anti")
