import base64
import hashlib
import random
import re
from datetime import datetime, timezone
from pathlib import Path

import pytest

from strandlake.llm import warc
from strandlake.llm._store import fresh_path

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(rows):
    last = {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        of = last[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == of else "revisit", None if i == of else of))
    return sorted(out, key=str)


def round_trip(spark, rows, parts=3):
    path = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS digest", "2 AS HTML", "3 AS row").repartition(parts)
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str), path


def test_round_trip_with_revisits(spark):
    rows = [(1, "<p>é</p>"), (2, None), (3, ""), (4, "<p>é</p>"), (5, "x" * 300000), (6, "a\r\n\r\nb"), (7, "<p>é</p>"), (8, "漢字\U0001f600")]
    assert round_trip(spark, rows)[0] == expected(rows)


def test_magic_inside_payloads_is_rejected(spark):
    rows = [(1, "before " + INNER + " after"), (2, INNER), (3, INNER * 5 + "x"), (4, "WARC/1.1\r\n"), (5, "plain"), (6, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (7, INNER)]
    assert round_trip(spark, rows)[0] == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_over_small_splits(spark, seed):
    """With splits of a few hundred bytes records cross splits, and the chain has to be followed by pointer jumping."""
    rng = random.Random(seed)
    pieces = ["<p>text</p>", INNER, "WARC/1.1\r\n", "\r\n\r\n", "é漢"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(60)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got, path = round_trip(spark, rows, parts=2)
        assert got == expected(rows)
        cand = warc.candidates(spark, path)
        assert cand.select("file", "block").distinct().count() > 8
        assert warc.reachable(cand).count() == len(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_offsets_are_those_of_the_bytes(spark):
    _, path = round_trip(spark, [(1, "a" + INNER), (2, "é")], parts=1)
    raw = b"".join(p.read_bytes() for p in Path(path.removeprefix("file://")).glob("part-*"))
    want = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", raw)]
    assert sorted(r["at"] for r in warc.candidates(spark, path).where("at >= 0").collect()) == want


def test_records_have_the_fields_of_the_format(spark):
    path = fresh_path(spark, "warc-fields")
    rows = [(1, "x", "http://a.b/c d"), (2, "x", "http://e.f/\r\nWARC-Type: warcinfo"), (3, "y", None), (None, "z", "")]
    warc.write(spark.createDataFrame(rows, "page_id long, html string, URL string"), path, datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))
    raw = b"".join(p.read_bytes() for p in Path(path.removeprefix("file://")).glob("part-*")).decode()
    heads = [r.split("\r\n\r\n")[0].split("\r\n") for r in raw.split("WARC/1.1\r\n")[1:]]
    fields = [dict(line.split(": ", 1) for line in head) for head in heads]
    for head, f in zip(heads, fields):
        assert len(head) == len(f) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(f) and f["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert f["WARC-Type"] == "response" or {"WARC-Profile", "WARC-Refers-To"} <= set(f)
    assert {f["WARC-Record-ID"]: f["WARC-Target-URI"] for f in fields} == {"<urn:page:1>": "http://a.b/c%20d", "<urn:page:2>": "http://e.f/WARC-Type:%20warcinfo", "<urn:page:3>": "urn:page:3", "<urn:page:null>": "urn:page:null"}
    assert sorted(str(r["page_id"]) for r in warc.read(spark, path).collect()) == ["1", "2", "3", "None"]


def test_no_rows_and_repeated_rows(spark):
    assert round_trip(spark, [])[0] == []
    rows = [(1, "x"), (1, "x"), (2, "x"), (2, "x")]
    got = round_trip(spark, rows)[0]
    assert [g[3] for g in got] == ["response", "response", "revisit", "revisit"] or sorted(g[3] for g in got) == ["response", "response", "revisit", "revisit"]


def test_null_page_id(spark):
    got = round_trip(spark, [(None, "x"), (3, "x"), (None, "alone")])[0]
    assert sorted((g[0], g[3], g[4]) for g in got if g[0]) == [(3, "response", None)]
    assert sorted((g[3], g[4] or 0) for g in got if g[0] is None) == [("response", 0), ("revisit", 3)]
