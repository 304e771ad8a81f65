"""FASTA in, tables and models out."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.functions.sequences import file_class, header_class

SEQUENCES = T.StructType([
    T.StructField("seq_id", T.LongType()), T.StructField("sequence_name", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("length", T.IntegerType()), T.StructField("seq", T.StringType()),
])
#: File extensions of sequences (fixed values).
PATTERNS = "*.{fasta,fa,fna,FASTA,FA,FNA,Fasta,Fa,Fna}"

log = logging.getLogger("strandlake")


def empty_sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEQUENCES)


def read_fasta(spark: SparkSession, path: str, class_from: str = "file", with_place: bool = False) -> DataFrame:
    """The records of a FASTA file, or of all FASTA files of a folder: SEQUENCES.

    Files are read line by line in splits. A line's byte order within its split
    and the split's place in the file order the lines; a running count of header
    lines tells records apart, so a header may hold ``>`` and a record may span
    splits. ``class_from`` is "file" (the name without extension) or "header" (the
    name up to its first dot). White space inside a sequence goes, letters become
    upper case. A record without letters stays, with length 0. ``with_place`` adds
    the file and the record's number in it.
    """
    if class_from not in ("file", "header"):
        raise ValueError("class_from must be 'file' or 'header'")
    reader = spark.read.option("lineSep", "\n")
    single = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() in ("fasta", "fa", "fna")
    df = (reader if single else reader.option("pathGlobFilter", PATTERNS)).text(path)
    if not df.inputFiles():
        raise FileNotFoundError(f"No fasta files found in: {path}")
    meta = F.col("_metadata")
    lines = df.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("value"))
    lines = lines.withColumn("head", F.col("value").startswith(">"))
    # running number of headers: within a split, then over the splits of the file
    inside = lines.withColumn("k", F.sum(F.col("head").cast("long")).over(Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = lines.groupBy("file", "block").agg(F.sum(F.col("head").cast("long")).alias("heads"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("heads").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("heads")
    placed = inside.join(blocks, ["file", "block"]).withColumn("record", F.col("k") + F.col("before")).where("record > 0")
    parts = placed.groupBy("file", "record").agg(F.max(F.when(F.col("head"), F.substring("value", 2, 1 << 30))).alias("name"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("block", "n", "value")))).alias("rows"))
    seq = F.upper(F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["value"]), ""), r"\s", ""))
    named = parts.select("file", "record", F.trim("name").alias("sequence_name"), seq.alias("seq"))
    label = file_class(F.col("file")) if class_from == "file" else header_class(F.col("sequence_name"))
    # a number that does not depend on the run: where the file name and record number hash to
    number = F.xxhash64("file", "record")
    return named.select(number.alias("seq_id"), "sequence_name", label.alias("class"), F.length("seq").cast("int").alias("length"), "seq", *(["file", "record"] if with_place else []))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """read_fasta() by readers that name a record by the first word of its header: of records with one name the last stays (by file, then place in it)."""
    rows = read_fasta(spark, path, with_place=True).withColumn("sequence_name", first_word(F.col("sequence_name")))
    last = Window.partitionBy("sequence_name").orderBy(F.desc("file"), F.desc("record"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").select(*[f.name for f in SEQUENCES])


def first_word(name):
    """The name of a record in readers that cut headers at white space."""
    return F.split(name, r"\s+").getItem(0)


def save_checkpoint(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        log.info("wrote %s/%s", path, name)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
    log.info("wrote %s", path)


def save_models(trained: dict, path: str) -> None:
    """Each model of ``trained`` (name to Trained) under path, and the table of their measures as Parquet in path/comparison."""
    rows = []
    for name, one in trained.items():
        save_model(one.model, f"{path}/{name}")
        rows.append((name, one.accuracy, one.kappa, one.seconds))
        spark = one.predictions.sparkSession
    spark.createDataFrame(rows, "model string, accuracy double, kappa double, seconds double").write.mode("overwrite").parquet(f"{path}/comparison")
    log.info("wrote %s/comparison", path)


@contextmanager
def log_to(path: str) -> Iterator[None]:
    """What the engine logs inside also goes to a file on the driver."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    before = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(before)
        handler.close()


def read_numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
