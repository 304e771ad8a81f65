"""Training and test sets: quotas, seeded picks, alignment of k-mer columns, leakage."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

log = logging.getLogger("strandlake")


def long_enough(rows: DataFrame, min_size: int = 800) -> DataFrame:
    out = rows.where(F.col("length") >= min_size)
    if out.isEmpty():
        raise ValueError(f"no sequence has a length of at least {min_size}")
    return out


def quota(size: Column, seq_per_class: int | None, train_prop: float = 0.7, rule: str = "cap") -> Column:
    """Rows of a class that train. "cap": min(size, seq_per_class), all if None. "prop": seq_per_class if the class has as many, else max(1, floor(size * train_prop))."""
    if rule not in ("cap", "prop"):
        raise ValueError("rule must be 'cap' or 'prop'")
    if seq_per_class is None:
        return size.cast("long")
    if rule == "cap":
        return F.least(size, F.lit(seq_per_class)).cast("long")
    return F.when(size >= seq_per_class, F.lit(seq_per_class)).otherwise(F.greatest(F.lit(1), F.floor(size * F.lit(train_prop)))).cast("long")


def quotas(rows: DataFrame, seq_per_class: int | None, train_prop: float = 0.7, rule: str = "cap") -> DataFrame:
    sizes = rows.groupBy("class").agg(F.count("*").alias("size"))
    return sizes.select("class", "size", quota(F.col("size"), seq_per_class, train_prop, rule).alias("n_train"))


def pick(rows: DataFrame, seq_per_class: int | None, train_prop: float = 0.7, rule: str = "cap", seed: int | None = 123) -> DataFrame:
    """The training rows: the quota of each class in the order of a seeded hash of seq_id, or of seq_id itself if seed is None."""
    order = [F.col("seq_id")] if seed is None else [F.xxhash64("seq_id", F.lit(seed)), F.col("seq_id")]
    ranked = rows.withColumn("pick_rank", F.row_number().over(Window.partitionBy("class").orderBy(*order)))
    return ranked.join(quotas(rows, seq_per_class, train_prop, rule), "class").where(F.col("pick_rank") <= F.col("n_train")).drop("pick_rank", "n_train", "size")


def rest(rows: DataFrame, train: DataFrame) -> DataFrame:
    """All rows that do not train, too short ones included."""
    return rows.join(train.select("seq_id"), "seq_id", "left_anti")


def leaked(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("seq_id").join(test.select("seq_id"), "seq_id", "left_semi").distinct()


def stratified(rows: DataFrame, share: float) -> DataFrame:
    """rows with dataset train for the first ceil(share * size) of each class by seq_id, else test."""
    order = Window.partitionBy("class").orderBy("seq_id")
    sizes = rows.groupBy("class").agg(F.ceil(F.count("*") * F.lit(share)).alias("n_train"))
    ranked = rows.withColumn("pick_rank", F.row_number().over(order)).join(sizes, "class")
    return ranked.withColumn("dataset", F.when(F.col("pick_rank") <= F.col("n_train"), "train").otherwise("test")).drop("pick_rank", "n_train")


def common_kmers(train: DataFrame, test: DataFrame) -> DataFrame:
    """The k-mers (kmer) that both count tables hold."""
    return train.select("kmer").distinct().join(test.select("kmer").distinct(), "kmer", "left_semi")


def align_kmers(train: DataFrame, test: DataFrame, share: float = 0.7) -> DataFrame:
    """common_kmers() of two count tables; warns where they differ, and where fewer than ``share`` of the training set's k-mers are left."""
    common = common_kmers(train, test)
    n_train, n_test, n_common = (df.select("kmer").distinct().count() for df in (train, test, common))
    if not n_train == n_test == n_common:
        log.warning("train holds %d k-mers, test %d, both %d", n_train, n_test, n_common)
        if n_common < share * n_train:
            log.warning("only %.1f %% of the training k-mers are in the test set", 100 * n_common / n_train)
    return common


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    mode: str
    info: dict = field(default_factory=dict)


def select_train_test(rows: DataFrame, seq_per_class: int | None = None, min_size: int = 800, train_prop: float = 0.7, external_train: DataFrame | None = None, external_test: DataFrame | None = None, k: int | None = None, rule: str = "cap", seed: int = 123) -> Split:
    """Train and test rows in one of three modes: internal split, external test set, or both external."""
    if not 0 < train_prop < 1:
        raise ValueError("train_prop must lie between 0 and 1")
    if external_train is not None and external_test is None:
        raise ValueError("an external training set needs an external test set")
    if external_train is not None:
        if k is None:
            raise ValueError("k is needed with external sets")
        return Split(external_train, external_test, "fully_external", {"k": k})
    train = pick(long_enough(rows, min_size), seq_per_class, train_prop, rule, seed)
    if external_test is not None:
        return Split(train, external_test, "external_test_only", {"k": k})
    return Split(train, rest(rows, train), "internal_split", {"k": k, "rule": rule})
