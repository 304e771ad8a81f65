"""Best-fit packing of token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._memory import released
from strandlake.llm._store import cut, pick
from strandlake.llm._text import slices
from strandlake.llm.tokens import WordTokenizer

#: Pieces that are packed together, about; every such group leaves a few sequences that are not full.
GROUP = 1 << 16
#: Text bytes that are tokenized at once; arrays of word bounds take many times as much.
SLICE_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@released
def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = WordTokenizer.load(tokenizer)
    for batch in batches:
        for row, data, offsets in slices(batch.column(1), SLICE_BYTES):
            out: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(words.encode(data, offsets)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                raw = ids.tobytes()
                for piece, start in enumerate(range(0, len(ids), size)):
                    stop = min(len(ids), start + size)
                    out.append((row + i, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
            col = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(col[0])), pa.array(col[1].astype(np.int32)), *[pa.array(c) for c in col[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """The documents' ids, each followed by end_id, cut every ``size`` ids: doc_id, piece, start, length, ids_crc32. Null and empty texts are end_id alone."""
    tokenizer = tokenizer or default_tokenizer()
    return pick(docs, "doc_id", "text").mapInArrow(partial(_piece_batches, tokenizer=tokenizer, size=size, end_id=end_id), _PIECES)


def sum_of_squares(lengths: np.ndarray, size: int, loads: np.ndarray | None = None) -> np.ndarray:
    """The bin of each length, in the given order.

    count[g] is the number of open bins with gap g. A piece goes where the sum of
    squared counts becomes smallest, a new bin included; of equal choices, where
    least room stays. Full bins have gap 0 and count as closed.

    With ``loads``, bins of those loads are there from the start, and a new one is
    opened only for a piece that fits none.
    """
    count = np.zeros(size + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0
    for load in () if loads is None else loads.tolist():
        if load < size:
            bins[size - load].append(used)
            count[size - load] += 1
        used += 1
    where = np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        # how the sum changes if a bin of gap g + n gets gap g; at g = 0 the bin closes and counts no more
        before = count[n:]
        change = 2 * (count[: size - n + 1] - before + 1)
        change[0] -= 1
        change[before == 0] = 1 << 60
        g = int(change.argmin())
        best = int(change[g])
        none = best >= 1 << 60
        if none or (loads is None and (n == size or best > 2 * count[size - n] + 1)):
            place, gap = used, size - n
            used += 1
        else:
            gap = g
            place = bins[g + n].pop()
            count[g + n] -= 1
        where[i] = place
        if gap:
            bins[gap].append(place)
            count[gap] += 1
    return where


def dissolve(lengths: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """The bins after the emptiest ones are dissolved and their pieces, long ones first, placed anew by the same rule; as it was if that saves none.

    The sum-of-squares rule keeps bins of many gaps open for pieces to come. When
    none come, the last bins' pieces do.
    """
    load = np.bincount(where, weights=lengths).astype(np.int64)
    spare = len(load) - -(-int(lengths.sum()) // size)
    for more in (1, 2, 4, 8, 16):
        if spare <= 0 or more * spare > len(load):
            break
        order = np.argsort(load, kind="stable")
        goes, stays = order[: more * spare], order[more * spare :]
        name = np.full(len(load), -1)
        name[stays] = np.arange(len(stays))
        moving = np.flatnonzero(name[where] < 0)
        moving = moving[np.argsort(-lengths[moving], kind="stable")]
        new = name[where]
        new[moving] = sum_of_squares(lengths[moving], size, load[stays])
        if new.max() + 1 < len(load):
            where = new
            load = np.bincount(where, weights=lengths).astype(np.int64)
            spare = len(load) - -(-int(lengths.sum()) // size)
    return where


def offsets_in(where: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts in its bin, in the order given."""
    order = np.argsort(where, kind="stable")
    run = np.cumsum(lengths[order]) - lengths[order]
    new = np.r_[True, where[order][1:] != where[order][:-1]] if len(order) else np.zeros(0, bool)
    base = run[new][np.cumsum(new) - 1] if len(order) else run
    out = np.empty(len(order), np.int64)
    out[order] = run - base
    return out


def _pack_group(group: pd.DataFrame, size: int) -> pd.DataFrame:
    group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    lengths = group["length"].to_numpy()
    where = dissolve(lengths, sum_of_squares(lengths, size), size)
    return pd.DataFrame({**{c: group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": group["grp"].to_numpy() * (1 << 32) + where, "offset": offsets_in(where, lengths)})


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids: a row per piece with its sequence_id and offset.

    Pieces are dealt evenly into groups of about GROUP, whose number grows with
    the input; each group is packed on its own, long pieces first, by the
    sum-of-squares rule, and then its emptiest sequences are dissolved and their
    pieces placed anew by the same rule, if that saves sequences.  Dealing goes by row number, so neither repeated rows nor
    a long document meet in one task.  Null text is empty; a null doc_id and
    repeated rows are packed like others; extra columns are ignored; no rows give
    no sequences.
    """
    spread = cut(pieces(docs, tokenizer, size, end_id), "pieces")
    groups = max(1, math.ceil(spread.count() / GROUP))
    rows = spread.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return rows.groupBy("grp").applyInPandas(partial(_pack_group, size=size), _PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids: nulls, repeated rows and empty tables as pack() states."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2048)
