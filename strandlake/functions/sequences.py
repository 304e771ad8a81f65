"""Column expressions and small checks on sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"


def header_class(name: Column) -> Column:
    """What stands before the first dot of a sequence name."""
    return F.regexp_replace(name, r"\..*", "")


def file_class(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def letters_to_alphabet(text: Column, alphabet: str = "ACGT") -> Column:
    """Text as a sequence: the letters a-z of its lower case, dealt over the alphabet in turn."""
    target = (alphabet * 26)[:26]
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LOWER, target)


def from_documents(documents: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """documents as sequences: (seq_id, sequence_name, class, length, seq)."""
    seq = letters_to_alphabet(F.col("text"), alphabet)
    rows = documents.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sequence_name"), F.coalesce("lang", F.lit("?")).alias("class"), seq.alias("seq"))
    return rows.select("seq_id", "sequence_name", "class", F.length("seq").alias("length"), "seq")


def require_columns(df: DataFrame, names: list[str], dataset: str) -> DataFrame:
    """df, with CLASS renamed to class where class is missing; an error names the columns that are not there."""
    if "class" not in df.columns and "CLASS" in df.columns:
        df = df.withColumnRenamed("CLASS", "class")
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"Missing columns in {dataset}: {', '.join(missing)}")
    return df


def drop_class(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() == "class"])
