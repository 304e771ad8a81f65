"""Media columns: ISO base media files, written and walked box by box."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._store import pick, spread
from strandlake.llm._text import slices

#: Bytes of a sample, samples of a chunk, samples from one keyframe to the next, and ticks of a second, in files that mux() writes.
SAMPLE, CHUNK, KEYFRAMES, TIMESCALE = 64, 128, 16, 8000
#: Levels that boxes are followed down to; real files have about ten.
DEPTH = 32
#: Boxes that only hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, version: int, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples that holds payload, whose length is a positive multiple of SAMPLE. It depends on nothing else."""
    n = len(payload) // SAMPLE
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso6")
    mdat = _box(b"mdat", payload)
    first = len(head) + len(mdat) - len(payload)
    chunks = np.arange(0, n, CHUNK, dtype=np.int64) * SAMPLE + first
    wide = len(head) + len(mdat) >= 1 << 32
    runs = [(1, CHUNK, 1), (n // CHUNK + 1, n % CHUNK, 1)]
    runs = [r for r in runs if r[1] and not (r[0] == 1 and r[1] == CHUNK and n < CHUNK)]
    keys = np.arange(1, n + 1, KEYFRAMES, dtype=">u4")
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))),
        _full(b"stts", 0, struct.pack(">III", 1, n, SAMPLE)),
        _full(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", 0, struct.pack(">II", SAMPLE, n)),
        _full(b"co64" if wide else b"stco", 0, struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"smhd", 0, bytes(4)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 0, flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", 1, struct.pack(">QQIQHH", 0, 0, TIMESCALE, n * SAMPLE, 0x55C4, 0)), _full(b"hdlr", 0, struct.pack(">I4s12s", 0, b"soun", bytes(12)), b"\0"), minf)
    trak = _box(b"trak", _full(b"tkhd", 1, struct.pack(">QQIIQ8xhhHH", 0, 0, 1, 0, n * SAMPLE, 0, 0, 0x100, 0), unity, bytes(8), flags=3), mdia)
    mvhd = _full(b"mvhd", 1, struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, n * SAMPLE, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
    return head + mdat + _box(b"moov", mvhd, trak)


def walk(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, nested ones after their container. A box that runs past its container ends the level; boxes below DEPTH levels are not followed."""
    levels: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while levels:
        begin, end, path = levels.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if body + 8 > end:
                continue
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - begin
        if begin + size > end or body > begin + size:
            continue
        yield (*path, kind), body, begin + size
        levels.append((begin + size, end, path))
        if kind in CONTAINERS and len(path) + 1 < DEPTH:
            levels.append((body, begin + size, (*path, kind)))


def _tables(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """One track's sample tables: byte offset, size and duration of each sample, and which are keyframes.

    No table is read beyond its box, and no more samples than bytes of the file
    are made of one, whatever the counts in it say.
    """

    def ints(kind: bytes, skip: int, width: int, count: int, what: str = ">u4") -> np.ndarray:
        begin, end = boxes[kind]
        count = min(count * width, max(0, end - begin - skip) // np.dtype(what).itemsize) // width * width
        return np.frombuffer(data, what, count, begin + skip).astype(np.int64).reshape(-1, width)

    count = lambda kind, at=4: struct.unpack_from(">I", data, boxes[kind][0] + at)[0] if kind in boxes else 0
    same, n = count(b"stsz"), count(b"stsz", 8)
    if same and n * same > len(data):
        raise ValueError("samples of more bytes than the file has")
    sizes = np.full(n, same, np.int64) if same else ints(b"stsz", 12, 1, n)[:, 0] if n else np.zeros(0, np.int64)
    if b"co64" in boxes:
        chunks = ints(b"co64", 8, 1, count(b"co64"), ">u8")[:, 0]
    else:
        chunks = ints(b"stco", 8, 1, count(b"stco"))[:, 0] if count(b"stco") else np.zeros(0, np.int64)
    runs = ints(b"stsc", 8, 3, count(b"stsc")) if count(b"stsc") else np.zeros((0, 3), np.int64)
    firsts = runs[:, 0]
    if len(runs) and (firsts[0] < 1 or (np.diff(firsts) <= 0).any()):
        raise ValueError("chunk runs out of order")
    # each chunk's run is the last that begins with it or before
    run = np.searchsorted(firsts, np.arange(1, len(chunks) + 1), "right") - 1
    per = np.where(run >= 0, np.minimum(runs[run, 1], len(sizes)), 0) if len(runs) else np.zeros(len(chunks), np.int64)
    held = np.minimum(np.cumsum(per), len(sizes))
    chunk = np.repeat(np.arange(len(chunks)), np.diff(held, prepend=0))
    sizes = sizes[: len(chunk)]
    start = np.cumsum(sizes) - sizes
    opens = np.zeros(len(chunks), np.int64)
    if len(chunk):
        new = np.flatnonzero(np.diff(chunk, prepend=-1))
        opens[chunk[new]] = start[new]
        start = start - opens[chunk] + chunks[chunk]
    times = ints(b"stts", 8, 2, count(b"stts")).tolist() if count(b"stts") else []
    keys = ints(b"stss", 8, 1, count(b"stss"))[:, 0] - 1 if b"stss" in boxes and count(b"stss") else np.arange(len(sizes)) if b"stss" not in boxes else np.zeros(0, np.int64)
    return {"offset": start, "size": sizes, "ticks": sum(samples * ticks for samples, ticks in times), "keys": keys[(keys >= 0) & (keys < len(sizes))]}


def probe(data: bytes | None) -> dict | None:
    """The first track of a file: codec, timescale, ticks, samples, and keyframe (offset, size) ranges; sample bytes stay as they are.

    None if no track can be read, or if its tables speak of bytes that the file does not have.
    """
    boxes: dict[bytes, tuple[int, int]] = {}
    for path, begin, end in walk(data or b""):
        if path[-1] == b"trak" and b"stbl" in boxes:
            break
        boxes.setdefault(path[-1], (begin, end))
    try:
        begin, end = boxes[b"mdhd"]
        timescale = struct.unpack_from(">I", data, begin + (20 if data[begin] else 12))[0]
        codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
        t = _tables(data, boxes)
    except (KeyError, struct.error, ValueError, IndexError):
        return None
    if len(t["offset"]) and (t["offset"].min() < 0 or t["offset"].max() > len(data) or (t["offset"] + t["size"]).max() > len(data)):
        return None
    t |= {"codec": codec, "timescale": timescale, "key_offset": t["offset"][t["keys"]], "key_size": t["size"][t["keys"]]}
    return t


def stored_payload(data: bytes, track: dict) -> bytes:
    """The track's samples in order, copied run by run from where its tables say they lie."""
    off, size = track["offset"], track["size"]
    if not len(off):
        return b""
    new = np.flatnonzero(np.r_[True, off[1:] != off[:-1] + size[:-1]])
    stop = np.r_[new[1:], len(off)] - 1
    return b"".join(data[off[a] : off[b] + size[b]] for a, b in zip(new, stop))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % SAMPLE if text else SAMPLE)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            part = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array([mux(padded(x)) for x in part], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the UTF-8 text, padded with bytes 0 to a positive multiple of 64, as the samples of an ISO file.

    Null and empty texts are 64 bytes 0. Equal texts give equal files. Rows are
    independent; repeated rows, a null doc_id and extra columns change nothing.
    """
    return spread(pick(docs, "doc_id", "text")).mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, samples long, key_offset array<long>, key_size array<long>"


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _DESCRIBED.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    kinds = [types[x.split(" ")[1]] for x in _DESCRIBED.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(batch.column(i) for i in range(3))):
            media = media.as_py()
            track = probe(media)
            if track is None:
                rows.append((doc_id.as_py(), n_bytes.as_py(), None, None, None, media and len(media), media and hashlib.sha256(media).hexdigest(), *[None] * 5))
                continue
            payload = stored_payload(media, track)
            rows.append((doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), track["codec"], track["ticks"] / track["timescale"] if track["timescale"] else None, len(track["size"]), track["key_offset"], track["key_size"]))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def describe(media: DataFrame) -> DataFrame:
    """What the boxes and sample tables of a media column say: codec, duration, samples and keyframe byte ranges, with digests of the stored samples and of the file.

    A null or unreadable file has null features. Nothing is decoded.
    """
    return pick(media, "doc_id", "n_bytes", "media").mapInArrow(_describe_batches, _DESCRIBED)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a media file, read back: digests, codec, duration and keyframe byte ranges; equal texts give equal values."""
    out = describe(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ranges = F.crc32(F.encode(F.concat(F.to_json("key_offset"), F.to_json("key_size")), "UTF-8"))
    feature = F.format_string("%s;%.3fs;%d samples;%d keyframes;%d", F.trim("codec"), "duration_s", "samples", F.size("key_offset"), ranges)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration_s", "key_offset", "key_size")
