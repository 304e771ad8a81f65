"""Where motifs occur in sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Occurrences that a task holds before it hands them on, in about.
HELD = 1 << 16
_FOUND = "motif string, sequence_name string, class string, position_start int, position_end int, sequence_length int"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.string()] * 3 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split(" ")[0] for x in _FOUND.split(", ")])


def _find(batches: Iterator[pa.RecordBatch], motifs: list[str], overlap: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            name, label, seq = (c[i].as_py() for c in batch.columns)
            for motif in motifs:
                at = seq.find(motif) if seq else -1
                while at >= 0:
                    rows.append((motif, name, label, at + 1, at + len(motif), len(seq)))
                    if len(rows) >= HELD:
                        yield _record(rows)
                        rows = []
                    at = seq.find(motif, at + (1 if overlap else len(motif)))
    yield _record(rows)


def find_motifs(seqs: DataFrame, motifs: list[str], overlap: bool = False) -> DataFrame:
    """A row for each literal occurrence, left to right without overlaps (unless overlap): positions from 1, ends included.

    motifs is a selection of bounded size; it goes to the tasks, sequences stay
    where they are. Repeated and empty motifs are dropped.
    """
    unique = [m for m in dict.fromkeys(motifs) if m]
    return seqs.select("sequence_name", "class", "seq").mapInArrow(partial(_find, motifs=unique, overlap=overlap), _FOUND)


def kmers_in_seq(seqs: DataFrame, motifs: list[str], validation: DataFrame | None = None, predicted: DataFrame | None = None, overlap: bool = False) -> DataFrame:
    """find_motifs() over training sequences and, if given, validation sequences, whose class is their predicted one; then a column dataset tells them apart."""
    found = find_motifs(seqs, motifs, overlap)
    if validation is None:
        return found
    if predicted is not None:
        validation = validation.drop("class").join(predicted.select("sequence_name", F.col("predicted").alias("class")), "sequence_name", "left")
    return found.withColumn("dataset", F.lit("train")).unionByName(find_motifs(validation, motifs, overlap).withColumn("dataset", F.lit("validation")))


def occurrences_by_dataset(found: DataFrame) -> DataFrame:
    return found.groupBy("dataset", "motif").agg(F.count("*").alias("n"))
