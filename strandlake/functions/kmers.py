"""k-mers: vocabulary, overlapping counts, and the counts of a single sequence."""

from __future__ import annotations

import re
import statistics
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DNA = ("A", "C", "G", "T")


def check_alphabet(alphabet) -> tuple[str, ...]:
    """The alphabet as a tuple of distinct single letters."""
    letters = tuple(alphabet) if isinstance(alphabet, (str, list, tuple)) else None
    if not letters or not all(isinstance(a, str) and len(a) == 1 for a in letters):
        raise ValueError("alphabet must be a non-empty list of single letters")
    if len(set(letters)) != len(letters):
        raise ValueError("alphabet must not repeat a letter")
    return letters


def check_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a single positive whole number")
    return k


def all_kmers(alphabet=DNA, k: int = 6) -> list[str]:
    """All strings of length k in the order of the alphabet."""
    out = [""]
    for _ in range(check_k(k)):
        out = [x + a for x in out for a in check_alphabet(alphabet)]
    return out


def vocabulary(spark: SparkSession, alphabet=DNA, k: int = 6) -> DataFrame:
    """(ord, kmer): all strings of length k, computed from their number, so that any size is spread over the cluster."""
    letters, k = check_alphabet(alphabet), check_k(k)
    a = len(letters)
    table = F.array(*[F.lit(x) for x in letters])
    digits = [F.element_at(table, (F.expr(f"id div {a ** (k - 1 - p)}") % a + 1).cast("int")) for p in range(k)]
    return spark.range(a**k).select(F.col("id").alias("ord"), F.concat(*digits).alias("kmer"))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; tables of many files stay as they are, and so do shuffled ones, whose partitions are adapted at run time (to count them would be to run them)."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def _codes(data: np.ndarray, offsets: np.ndarray, letters: tuple[str, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary number, row) of every window that lies within one row and holds letters of the alphabet only."""
    table = np.full(256, -1, np.int64)
    for i, x in enumerate(letters):
        table[ord(x.upper())] = table[ord(x.lower())] = i
    digit = table[data]
    n = len(digit) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for p in range(k):
        d = digit[p : p + n]
        code = code * len(letters) + d
        ok &= d >= 0
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    ok &= np.arange(n) + k <= offsets[row + 1]
    return code[ok], row[ok]


def _column(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(i).cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _count_sparse(batches: Iterator[pa.RecordBatch], letters: tuple[str, ...], k: int) -> Iterator[pa.RecordBatch]:
    width = len(letters) ** k
    for batch in _chunks(batches):
        code, row = _codes(*_column(batch, 2), letters, k)
        both, n = np.unique(row * width + code, return_counts=True)
        at = pa.array(both // width)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(both % width), pa.array(n.astype(np.int64))], names=["seq_id", "class", "ord", "n"])


def _count_groups(batches: Iterator[pa.RecordBatch], letters: tuple[str, ...], k: int) -> Iterator[pa.RecordBatch]:
    """Sums over all rows of a task that share a class, so that one row a class and k-mer is shuffled."""
    width = len(letters) ** k
    total: dict = {}
    for batch in _chunks(batches):
        code, row = _codes(*_column(batch, 1), letters, k)
        encoded = batch.column(0).dictionary_encode()
        names = encoded.dictionary.to_pylist()
        index = encoded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        both, n = np.unique(index[row] * width + code, return_counts=True)
        for g in np.unique(both // width):
            a, b = np.searchsorted(both, (g * width, (g + 1) * width))
            name = names[g] if g < len(names) else None
            if name not in total:
                total[name] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
            have, count = total[name]
            new, back = np.unique(np.r_[have, both[a:b] % width], return_inverse=True)
            total[name] = [new, np.bincount(back, weights=np.r_[count, n[a:b]], minlength=len(new)).astype(np.int64)]
    for name, (codes, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["class", "ord", "n"])


def _count_dense(batches: Iterator[pa.RecordBatch], letters: tuple[str, ...], k: int) -> Iterator[pa.RecordBatch]:
    width = len(letters) ** k
    for batch in _chunks(batches, 64):
        code, row = _codes(*_column(batch, 2), letters, k)
        n = np.bincount(row * width + code, minlength=batch.num_rows * width).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) + 1, width, dtype=np.int32)), pa.array(n))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["seq_id", "class", "counts"])


def _named(counts: DataFrame, letters: tuple[str, ...], k: int) -> DataFrame:
    """counts with kmer, spelled from its number ord."""
    a = len(letters)
    table = F.array(*[F.lit(x) for x in letters])
    digits = [F.element_at(table, (F.expr(f"ord div {a ** (k - 1 - p)}") % a + 1).cast("int")) for p in range(k)]
    return counts.withColumn("kmer", F.concat(*digits))


def count_by_sequence(seqs: DataFrame, k: int = 6, alphabet=DNA) -> DataFrame:
    """(seq_id, class, ord, kmer, n) for the k-mers that a sequence holds; windows with other letters are not counted, letter case does not matter."""
    letters = check_alphabet(alphabet)
    out = spread(seqs.select("seq_id", "class", "seq")).mapInArrow(partial(_count_sparse, letters=letters, k=check_k(k)), "seq_id long, class string, ord long, n long")
    return _named(out, letters, k)


def count_by_class(seqs: DataFrame, k: int = 6, alphabet=DNA, by: str = "class") -> DataFrame:
    """(class, ord, kmer, n): the counts of all sequences of a class, added up in each task before they are shuffled."""
    letters = check_alphabet(alphabet)
    out = spread(seqs.select(F.col(by).cast("string").alias("class"), "seq")).mapInArrow(partial(_count_groups, letters=letters, k=check_k(k)), "class string, ord long, n long")
    return _named(out.groupBy("class", "ord").agg(F.sum("n").alias("n")), letters, k).withColumnRenamed("class", by)


def count_arrays(seqs: DataFrame, k: int = 6, alphabet=DNA) -> DataFrame:
    """(seq_id, class, counts): dense counts in the order of the vocabulary."""
    return spread(seqs.select("seq_id", "class", "seq")).mapInArrow(partial(_count_dense, letters=check_alphabet(alphabet), k=check_k(k)), "seq_id long, class string, counts array<int>")


def zero_fill(counts: DataFrame, by: str, alphabet=DNA, k: int = 6) -> DataFrame:
    """counts (by, ord, kmer, n) with a row of 0 for each k-mer of the vocabulary that a group lacks.

    The groups are those that counts holds; the vocabulary is generated row by
    row of the group, so nothing is joined to all of it.
    """
    letters = check_alphabet(alphabet)
    width = len(letters) ** check_k(k)
    every = counts.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("ord"))
    filled = every.join(counts.select(by, "ord", "n"), [by, "ord"], "left").select(by, "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return _named(filled, letters, k)


def windows(sequence: str, word: int, step: int = 1) -> list[str]:
    return [sequence[i : i + word] for i in range(0, len(sequence) - word + 1, step)]


@dataclass(frozen=True)
class KmerCounts:
    """The counts of one sequence over the whole vocabulary, in its order."""

    counts: dict
    k: int
    alphabet: tuple
    sequence_length: int

    @property
    def total_kmers(self) -> int:
        return sum(self.counts.values())

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, names) -> "KmerCounts | int":
        if isinstance(names, str):
            return self.counts[names]
        if isinstance(names, slice):
            names = list(self.counts)[names]
        return self._only(names)

    def _only(self, names) -> "KmerCounts":
        return KmerCounts({x: self.counts[x] for x in names}, self.k, self.alphabet, self.sequence_length)

    def head(self, n: int = 6) -> "KmerCounts":
        return self._only(list(self.counts)[:n])

    def tail(self, n: int = 6) -> "KmerCounts":
        return self._only(list(self.counts)[-n:] if n else [])

    def subset(self, pattern: str | None) -> "KmerCounts":
        """The k-mers that a regular expression finds; warns if there are none."""
        if pattern is None:
            raise ValueError("a pattern is needed")
        names = [x for x in self.counts if re.search(pattern, x)]
        if not names:
            warnings.warn(f"no k-mer matches {pattern!r}", stacklevel=2)
        return self._only(names)

    def sort(self, decreasing: bool = False) -> "KmerCounts":
        return self._only(sorted(self.counts, key=lambda x: -self.counts[x] if decreasing else self.counts[x]))

    def top(self, n: int = 10) -> list[tuple[str, int]]:
        return list(self.sort(decreasing=True).counts.items())[:n]

    def summary(self) -> dict:
        v = list(self.counts.values())
        return {
            "total_kmers": sum(v), "possible_kmers": len(v), "observed_kmers": sum(x > 0 for x in v), "zero_kmers": sum(x == 0 for x in v),
            "min_count": min(v, default=0), "max_count": max(v, default=0), "mean_count": round(sum(v) / len(v), 2) if v else 0.0, "median_count": statistics.median(v) if v else 0,
        }

    def __str__(self) -> str:
        lines = [f"{self.k}-mers of a sequence of {self.sequence_length} letters: {self.total_kmers} windows, {len(self)} possible"]
        return "\n".join([*lines, *(f"{name} {n}" for name, n in self.top())])


def count_kmers(sequence, k: int = 6, alphabet=DNA) -> KmerCounts:
    """Strict counts of one sequence: any letter outside the alphabet, or a k longer than the sequence, is an error. Of several sequences the first counts, with a warning."""
    k, letters = check_k(k), check_alphabet(alphabet)
    if isinstance(sequence, (list, tuple)):
        if len(sequence) > 1:
            warnings.warn("several sequences; the first counts", stacklevel=2)
        sequence = sequence[0] if sequence else None
    if not isinstance(sequence, str) or not sequence:
        raise ValueError("sequence must be a single non-empty string")
    sequence = sequence.upper()
    if k > len(sequence):
        raise ValueError("k is longer than the sequence")
    if odd := sorted(set(sequence) - set(letters)):
        raise ValueError(f"letters outside the alphabet: {', '.join(odd)}")
    counts = dict.fromkeys(all_kmers(letters, k), 0)
    for w in windows(sequence, k):
        counts[w] += 1
    return KmerCounts(counts, k, letters, len(sequence))
