import hashlib
import struct
import zlib

import pytest

from strandlake.llm import media
from tests.llm.conftest import EDGES


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 127, 128, 129, 256, 1000])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n * media.SAMPLE))
    data = media.mux(payload)
    track = media.probe(data)
    assert media.stored_payload(data, track) == payload
    assert track["codec"] == "raw " and track["ticks"] == len(payload) and len(track["size"]) == n
    assert len(track["key_offset"]) == -(-n // media.KEYFRAMES)
    for k, (at, size) in enumerate(zip(track["key_offset"], track["key_size"])):
        begin = k * media.KEYFRAMES * media.SAMPLE
        assert data[at : at + size] == payload[begin : begin + size]


def test_walks_nested_and_large_boxes():
    inner = struct.pack(">I4s", 12, b"abcd") + b"1234"
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    data = moov + struct.pack(">I4s", 0, b"free") + b"rest"
    assert [(p, data[a:b]) for p, a, b in media.walk(data)] == [((b"moov",), inner), ((b"moov", b"abcd"), b"1234"), ((b"free",), b"rest")]


@pytest.mark.parametrize("data", [None, b"", b"x" * 7, b"\0\0\0\0", struct.pack(">I4s", 500, b"moov"), struct.pack(">I4s", 8, b"moov")])
def test_what_cannot_be_read_has_no_track(data):
    assert media.probe(data) is None


def _patched(kind, skip, value):
    """A file in which the number that lies skip bytes into a box's body is another."""
    data = bytearray(media.mux(bytes(64 * 40)))
    begin = next(a for p, a, _ in media.walk(bytes(data)) if p[-1] == kind)
    data[begin + skip : begin + skip + 4] = struct.pack(">I", value)
    return bytes(data)


@pytest.mark.parametrize("kind,skip", [(b"stsz", 4), (b"stsz", 8), (b"stsc", 4), (b"stsc", 8), (b"stsc", 12), (b"stco", 4), (b"stco", 8), (b"stss", 4), (b"stss", 8), (b"stts", 4), (b"stts", 8), (b"stts", 12), (b"mdhd", 20)])
@pytest.mark.parametrize("value", [0, 1, 0x7FFFFFFF, 0xFFFFFFFF])
def test_crafted_numbers(kind, skip, value):
    """No count, size or offset of a table makes the reader ask for much memory, crash, or return bytes that are not there."""
    data = _patched(kind, skip, value)
    track = media.probe(data)
    if track is not None:
        assert len(track["size"]) <= len(data) and len(media.stored_payload(data, track)) == track["size"].sum()
        assert all(0 <= a and a + n <= len(data) for a, n in zip(track["key_offset"], track["key_size"]))


def test_ranges_outside_the_file_are_no_track():
    assert media.probe(_patched(b"stco", 8, 1 << 30)) is None and media.probe(_patched(b"stsz", 8, 1 << 30)) is None


def test_deep_boxes():
    data = b""
    for _ in range(3000):
        data = struct.pack(">I4s", 8 + len(data), b"moov") + data
    assert media.probe(data) is None and sum(1 for _ in media.walk(data)) == media.DEPTH


def test_query_features(spark, tmp_path, make_docs):
    make_docs(EDGES, clash=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.query(spark, str(tmp_path)).collect()
    assert len(got) == len(EDGES)
    for r in got:
        samples = r["payload_bytes"] // media.SAMPLE
        keys = -(-samples // media.KEYFRAMES)
        assert r["feature"].startswith(f"raw;{r['payload_bytes'] / media.TIMESCALE:.3f}s;{samples} samples;{keys} keyframes;")
        first = r["key_offset"][0]
        assert list(r["key_offset"]) == [first + k * media.KEYFRAMES * media.SAMPLE for k in range(keys)] and list(r["key_size"]) == [media.SAMPLE] * keys


def test_truncated_files_do_not_crash():
    data = media.mux(bytes(64 * 200))
    for n in range(0, len(data), 37):
        media.probe(data[:n])


def test_tables_of_variable_samples():
    """Sizes of their own, two chunk runs, and no sync table: every sample is a keyframe."""
    sizes, chunks = [3, 5, 7, 2, 9], [1000, 2000, 3000]
    boxes, at, data = {}, 0, b""
    for kind, body in (
        (b"stsz", struct.pack(">III5I", 0, 0, 5, *sizes)), (b"stco", struct.pack(">II3I", 0, 3, *chunks)), (b"stsc", struct.pack(">II6I", 0, 2, 1, 2, 1, 3, 1, 1)), (b"stts", struct.pack(">II4I", 0, 2, 2, 10, 3, 20)),
    ):
        boxes[kind] = (at, at + len(body))
        data, at = data + body, at + len(body)
    t = media._tables(data, boxes)
    assert t["offset"].tolist() == [1000, 1003, 2000, 2007, 3000] and t["size"].tolist() == sizes and t["ticks"] == 80 and len(t["keys"]) == 5


def test_query_columns(make_docs):
    rows = EDGES
    got = media.describe(media.store(make_docs(rows))).collect()
    want = sorted((str(i), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-64:]), len((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["payload_sha256"], r["tail_crc32"], r["n_bytes"]) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add(r["media_sha256"])
    assert all(len(v) == 1 for v in by_text.values())
    assert media.describe(media.store(make_docs([]))).collect() == []
