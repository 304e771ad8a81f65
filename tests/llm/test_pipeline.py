import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandlake.llm import _store, mixing
from tests.llm.conftest import DOCS
from tests.llm.test_language_id import text
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_groups


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de", "fr", "es"])
        body = "\n".join(text(rng, lang, 12) for _ in range(4))
        if i % 3 == 0:
            body += "\nAll Rights Reserved "
        rows.append((i, body, lang, f"src{rng.randrange(6)}", len(body)))
    for i in range(30):
        words = rows[i % 5][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        copy = " ".join(words) if i % 2 else rows[i % 5][1]
        rows.append((200 + i, copy, rows[i % 5][2], "src0", len(copy)))
    rows += [(300, None, "en", "src0", 0), (301, "", None, None, 0), (302, "123 456 !!", "en", "src1", 10), (303, "one", None, "src1", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def kept(spark, corpus):
    """What each stage returned, one after the other, as lists of rows."""
    out, docs = [corpus.collect()], corpus
    for _, stage in cp.STAGES[:-1]:
        rows = stage(spark, docs, "").collect()
        docs = spark.createDataFrame(rows, DOCS)
        out.append(rows)
    return out, cp.pack_sequences(spark, docs, "").collect()


def test_stages_are_the_asked_ones():
    assert [name for name, _ in cp.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "packing"]


def test_language_stage_rejects_texts_without_language(kept):
    (before, after, *_), _ = kept
    letters = {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in after} == letters
    known = {r["doc_id"]: r for r in before}
    for r in after:
        # a missing language is the predicted one
        assert r["lang"] == (known[r["doc_id"]]["lang"] or r["lang"]) and r["lang"] in {"en", "de", "fr", "es"}
        assert (r["text"], r["source"], r["n_chars"]) == (known[r["doc_id"]]["text"], known[r["doc_id"]]["source"], known[r["doc_id"]]["n_chars"])
    assert any(known[r["doc_id"]]["lang"] is None for r in after)


def test_line_stage(kept):
    (_, before, after, *_), _ = kept
    want = {i: t for i, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in before], 10)}
    assert {r["doc_id"]: r["text"] for r in after} == want and any("Rights" in r["text"] for r in before) and not any("Rights" in r["text"] for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after) and after[0].__fields__ == list(cp.COLUMNS)


def test_near_duplicate_stage_keeps_one_of_each_group(kept):
    (_, _, before, after, _), _ = kept
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {i for i, _, _, keep in groups if keep} and len(after) < len(before)


def test_mixing_stage(spark, kept):
    """The rows are those of the mixing operator's SQL, at the pipeline's target and with one epoch."""
    (_, _, _, before, after), _ = kept
    sql = mixing.SQL.replace("sum(tokens) * 0.5", f"sum(tokens) * {cp.MIX_SHARE}").replace("2 * sum(n_tokens)", "1 * sum(n_tokens)")
    assert sql.count(f"* {cp.MIX_SHARE}") == 1 and sql.count("1 * sum(n_tokens)") == 1
    db = duckdb.connect()
    db.register("documents", pa.Table.from_pylist([r.asDict() for r in before]))
    taken = {r[0] for r in db.execute(sql).fetchall()}
    assert {r["doc_id"] for r in after} == taken and 0 < len(after) < len(before)


def test_packing_stage(kept):
    (*_, before), pieces = kept
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before}
    load = {}
    for r in pieces:
        load[r["sequence_id"]] = load.get(r["sequence_id"], 0) + r["length"]
    assert max(load.values()) <= 2048 and len(load) <= -(-sum(load.values()) // 2048) + 1


def test_run_writes_and_rereads(spark, tmp_path, corpus, kept):
    corpus.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(_store._written[spark.sparkContext.applicationId])
    got = cp.run(spark, str(tmp_path))
    # one table is left, the one that the result reads
    assert len(set(_store._written[spark.sparkContext.applicationId]) - before) == 1
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept[1])


def test_near_duplicates_are_told_apart_by_row(spark):
    """A unique text stays though its doc_id has a near-duplicate as well; equal rows stay once; rows without doc_id stay."""
    words = [f"w{i}" for i in range(60)]
    first, near, own = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(words[::-1])
    rows = [(9, first), (2, near), (9, own), (4, "a b c d e f"), (4, "a b c d e f"), (None, first), (None, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in cp.drop_near_duplicates(spark, docs, "").collect()))
    assert got == sorted([(2, near), (9, own), (4, "a b c d e f"), (0, first), (0, "x y z")])


def test_mixture_keeps_the_rows_that_it_took(spark):
    """Rows without doc_id stay if taken, and of rows that share one, only those that were taken."""
    rows = [(None if i % 3 == 0 else i % 5, f"text {i} " + "word " * (i % 7)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], DOCS)
    taken = sum(r["n_tokens"] for r in mixing.mix(docs, cp.MIX_SHARE, 1).collect())
    got = cp.mix_sources(spark, docs, "").collect()
    assert sum(len(r["text"].split()) for r in got) == taken and any(r["doc_id"] is None for r in got)
    assert len({r["text"] for r in got}) == len(got) < len(rows)


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    odd = spark.createDataFrame([(1, "same text here", "en", None, 1)] * 3 + [(None, "a b c", None, "x", 3), (2, None, None, None, None)], DOCS).withColumns({"TEXT2": F.lit(1), "score": F.lit(2), "lang_pred": F.lit("x")})
    for _, stage in cp.STAGES:
        stage(spark, empty, "").collect()
        stage(spark, odd, "").collect()
