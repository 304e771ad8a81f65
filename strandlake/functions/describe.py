"""Short summaries of results, as small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"), F.min("length").alias("min_length"), F.round(F.avg("length"), 2).alias("mean_length"), F.max("length").alias("max_length"))


def class_distribution(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("class").agg(F.count("*").alias("n")).orderBy("class")


def clusters(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("clusters"), F.sum("n_elements").alias("elements"), F.min("homogeneity").alias("min_homogeneity"), F.min("n_elements").alias("min_size"), F.count_if("is_complete_class").alias("complete"))


def motifs(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count_distinct("ord").alias("kmers"), F.count_distinct("cluster").alias("clusters"), F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"))


def dendrogram(tree) -> str:
    height = max((m[2] for m in tree.merges), default=0.0)
    return f"{len(tree.order)} leaves, {len(set(tree.labels))} classes, height {height:.4g}"


def selection(chosen) -> str:
    return "\n".join([f"{chosen.case}: n {chosen.n}, k {chosen.k}, m {chosen.m}", *(f"{c}: {', '.join(v)}" for c, v in chosen.motifs.items())])


def split(parts) -> DataFrame:
    label = lambda df, name: df.groupBy("class").agg(F.count("*").alias("n")).withColumn("dataset", F.lit(name))
    return label(parts.train, "train").unionByName(label(parts.test, "test"))


def occurrences(found: DataFrame, n: int = 10) -> DataFrame:
    return found.orderBy("motif", "sequence_name", "position_start").limit(n)
