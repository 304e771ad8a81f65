"""Line dedup: lines that many documents share go; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._store import cut, pick, small_or_shuffled

#: What is stripped at both ends of a line.
BLANK = " \t\n\x0b\f\r"


def _key(line: Column) -> Column:
    """A string equal for two lines if and only if their stripped, A-Z lower-cased forms are.

    lower() would fold other alphabets too, and translate() costs a table look-up
    a character.  So lower() sees the UTF-8 bytes as Latin-1: beside A-Z it moves
    only lead bytes of two-byte characters, and those stay distinct from the
    three-byte ones by the number of bytes that follow.
    """
    stripped = F.btrim(line, F.lit(BLANK))
    return F.lower(F.decode(F.encode(stripped, "UTF-8"), "ISO-8859-1"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop, in every document, the lines whose key at least ``min_docs`` documents hold.

    Returns doc_id, text (the other lines, joined by newline), n_lines, n_dropped
    and the columns that ``keep`` names.
    Lines are exploded and hashed (96 bits), distinct documents are counted for
    each hash, and documents are put together again from the positions that stay.

    Null or empty text is one empty line; an empty key is shorter than
    ``min_chars`` 1 and stays.  A null doc_id counts as one document.  Repeated
    rows come back as often as they went in and count as one document.  Extra
    columns are ignored.  An empty table gives an empty one.
    """
    base = pick(docs, "doc_id", "text", *keep).withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("th", F.xxhash64("text"))
    lines = base.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", _key(F.col("line"))).where(F.length(F.btrim("line", F.lit(BLANK))) >= max(1, min_chars))
    keyed = keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"))
    common = keyed.groupBy("k1", "k2").agg(F.count_distinct(F.struct("doc_id")).alias("n")).where(F.col("n") >= min_docs)
    common = small_or_shuffled(cut(common.select("k1", "k2"), "common-lines"), 24)
    gone = keyed.join(common, ["k1", "k2"], "left_semi").groupBy(F.struct("doc_id", "th").alias("row")).agg(F.collect_set("pos").alias("gone"))
    split = F.split("text", "\n", -1)
    joined = base.withColumn("row", F.struct("doc_id", "th")).join(gone, "row", "left")
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return (
        joined.withColumn("lines", split)
        .withColumn("at", F.array_sort(at))
        .select(
            "doc_id",
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n")).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("at")).cast("long").alias("n_dropped"),
            *keep,
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents share, as digests: nulls, repeated rows and empty tables as line_dedup() states."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM numbered),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT r, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept JOIN numbered d USING (r) GROUP BY r, d.doc_id
"""
