import hashlib

import duckdb
import pytest
from tests.llm.conftest import EDGES

from strandlake.llm import line_dedup


def brute(rows, min_docs):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                seen.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_matches_brute_force(make_docs, min_docs):
    rows = [*EDGES, (20, "Common LINE\nown a\n common line\t"), (21, "common line\nown b"), (22, "\n\nCOMMON LINE"), (23, "É line"), (24, "é line"), (25, "É line"), (26, "own b\n\nown b")]
    got = line_dedup.line_dedup(make_docs(rows), min_docs=min_docs)
    assert order(tuple(r) for r in got.collect()) == order(brute(rows, min_docs))


def test_empty_table(make_docs):
    assert line_dedup.line_dedup(make_docs([])).collect() == []


def test_two_byte_letters_stay_apart_from_three_byte_ones(make_docs):
    # lower-casing bytes as Latin-1 must not make different lines equal
    rows = [(i, t) for i, t in enumerate(["É", "é", "㉀", "Ã\u0089", "ã\u0089", "Z", "z"])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(make_docs(rows), min_docs=2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1}


def test_shuffled_join_gives_the_same(spark, make_docs):
    rows = [(i, f"shared\nown {i}\nSHARED ") for i in range(40)]
    want = order(tuple(r) for r in line_dedup.line_dedup(make_docs(rows)).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert order(tuple(r) for r in line_dedup.line_dedup(make_docs(rows)).collect()) == want == order(brute(rows, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sql_says_the_same(spark, tmp_path, make_docs):
    rows = [(i, f"shared\nown {i % 7}\nShared") for i in range(30)]
    make_docs(rows, clash=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in line_dedup.query(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL})").fetchall())
    assert got[0][3] == hashlib.sha256(b"own 0").hexdigest() or got[0][2] == 2


def test_plan_has_no_python(spark, make_docs):
    plan = line_dedup.line_dedup(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
