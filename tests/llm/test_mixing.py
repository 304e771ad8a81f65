import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing
from tests.llm.conftest import DOCS


def fill(total, caps, weights):
    """Raise the level step by step: whoever is full leaves, the others share by weight."""
    out, open_, left = {}, dict(caps), total
    while open_:
        w = sum(weights[c] for c in open_)
        full = [c for c in open_ if caps[c] * w <= left * weights[c]]
        if not full:
            return {**out, **{c: left * weights[c] / w for c in open_}}
        c = min(full, key=lambda c: (caps[c] / weights[c], c))
        out[c] = open_.pop(c)
        left -= out[c]
    return out


def test_budgets_flow_down_the_tree(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "fr", "c", 500), ("books", "en", "d", 30), ("news", "en", "e", 1000), ("news", "de", "f", 5)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("cap", F.col("tokens") * 2)
    weights = {"domain": {"web": 5, "books": 3}, "lang": {"en": 2}}
    for target in (0, 7, 300, 900, 2500, 99999):
        got = {r["source"]: r["budget"] for r in mixing.budgets(df, target, weights).collect()}
        cap = {r[2]: 2 * r[3] for r in leaves}
        total = min(target, sum(cap.values()))
        assert sum(got.values()) == total and all(0 <= got[s] <= cap[s] for s in got)
        top = fill(total, {d: sum(2 * r[3] for r in leaves if r[0] == d) for d in ("web", "books", "news")}, {"web": 5, "books": 3, "news": 1})
        for d in top:
            assert abs(sum(got[r[2]] for r in leaves if r[0] == d) - top[d]) < 1
        web = sum(got[r[2]] for r in leaves if r[0] == "web")
        langs = fill(web, {"en": 220, "fr": 1000}, {"en": 2, "fr": 1})
        assert abs(got["c"] - langs["fr"]) < 1
        english = fill(got["a"] + got["b"], {"a": 200, "b": 20}, {"a": 1, "b": 1})
        assert abs(got["b"] - english["b"]) < 1


def documents(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), ["en", "fr", None][i % 3], ["src0", "src0", "src5", "x", None][i % 5], 1) for i in range(400)]
    rows += [(1000, None, "en", "src0", 0), (1001, "", "en", "src0", 0), (1002, " \t", "fr", "src1", 0), (None, "a b c", "en", "src2", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("target,epochs", [(0.5, 2), (0.3, 1), (1.0, 1), (1.7, 2), (0.0, 2)])
def test_leaves_take_a_prefix_of_their_budget(spark, target, epochs):
    docs = documents(spark)
    got = mixing.mix(docs.selectExpr("*", "1 AS copies", "2 AS Lang"), target, epochs).collect()
    tokens = sum(len((r["text"] or "").split()) for r in docs.collect())
    taken = sum(r["n_tokens"] * r["copies"] for r in got)
    leaves = {(r["domain"], r["lang"], r["source"]) for r in got}
    assert all(1 <= r["copies"] <= epochs for r in got)
    assert int(tokens * target) <= taken <= int(tokens * target) + 13 * max(1, len(leaves))
    if target >= epochs:
        assert taken == tokens * epochs


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b", "en", "src0", 3)] * 50
    got = mixing.mix(spark.createDataFrame(rows, DOCS), 0.5, 1).collect()
    assert sum(r["n_tokens"] for r in got) == 50 and len({r["row"] for r in got}) == 25
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []


def test_sql_says_the_same(spark, tmp_path):
    documents(spark).where("doc_id is not null").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
    got = sorted(tuple(r) for r in mixing.query(spark, str(tmp_path)).select(*columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.SQL})").fetchall())
