"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, one after the other over documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last returns packed pieces.  run()
writes each stage's result as Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import language_id, line_dedup, mixing, near_dedup, packing
from strandlake.llm._store import cut, drop, pick, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose predicted language is surer than this stay.
MIN_LANGUAGE_SCORE = 0.05
#: Share of the tokens that the mixture takes.
MIX_SHARE = 0.8


def _numbered(docs: DataFrame, tag: str) -> DataFrame:
    """The documents' columns with a number for each row, ``at``: rows may share a doc_id, or have none."""
    return cut(pick(docs, *COLUMNS).withColumn("at", F.monotonically_increasing_id()), tag)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay: those without a letter, or with no sure prediction at all, go.

    The machines learn from the rows that have a lang and are not held out; a row
    without one gets the predicted language as its lang, so that mixing budgets it
    there. A given lang stays as it is. Null and empty texts have no letter and go.
    A null doc_id and repeated rows are judged like others, each on its own. No
    rows give none; without any lang to learn from, no language is recognised and
    all rows go. Extra columns are ignored.
    """
    docs = pick(docs, *COLUMNS)
    model = language_id.fit(docs.where(~language_id.held_out()))
    kept = language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; n_chars follows. No document goes.

    Null text becomes empty. A null doc_id counts as one document, repeated rows
    count as one and all stay. No rows give none; extra columns are ignored.
    """
    docs = pick(docs, *COLUMNS)
    return line_dedup.line_dedup(docs, min_docs=10, min_chars=1, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8) stays, that of the smallest doc_id.

    Rows that share a doc_id are told apart by a number of their own; of equal
    rows one stays. Rows without a doc_id, and texts without a word, all stay. No
    rows give none; extra columns are ignored.
    """
    docs = _numbered(docs, "near-rows")
    named = docs.where("doc_id is not null")
    groups = near_dedup.near_duplicates(named.select(F.col("at").alias("doc_id"), "text"), shingle=5, percent=80).select(F.col("doc_id").alias("at"), "component_id")
    first = named.select("at", "doc_id").join(groups, "at").groupBy("component_id").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    kept = first.select(F.col("first.at").alias("at"), F.lit(True).alias("kept"))
    return docs.join(kept, "at", "left").where("kept or doc_id is null").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the weighted mixture of domains, languages and sources takes, each once.

    Rows are drawn one by one, so those that share a doc_id, or have none, stay or
    go each by its own draw. Null languages and sources are branches of their own;
    texts without a word are never taken. No rows give none; extra columns are
    ignored.
    """
    docs = _numbered(docs, "mix-docs")
    taken = mixing.mix(docs, target=MIX_SHARE, epochs=1, keep=("at",)).select("at")
    return docs.join(taken, "at", "left_semi").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 ids.

    Null text is empty and one piece. A null doc_id and repeated rows are packed
    like others. No rows give none; extra columns are ignored.
    """
    return packing.pack(docs, size=2048)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Signatures, machines and packing have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order; nulls, repeated rows, empty tables and extra columns as each stage states.

    Each stage's result is written into the shared folder and read again as the
    next one's documents; then what the stage wrote on its way, and what it read,
    is removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            before, docs = docs, cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            kept.append(docs)
        drop(before)
    return docs
