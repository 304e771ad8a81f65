"""What is known of labelled clusters: homogeneity, dominant class, completeness, composition, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def members(rows: DataFrame) -> DataFrame:
    """(cluster, class, n) of rows with a cluster; a null cluster is no match."""
    return rows.where("cluster is not null").groupBy("cluster", "class").agg(F.count("*").alias("n"))


def homogeneity(rows: DataFrame) -> DataFrame:
    """(cluster, homogeneity): the share of the most frequent class."""
    return members(rows).groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("homogeneity"))


def dominant_class(rows: DataFrame) -> DataFrame:
    """(cluster, dominant_class): the most frequent class, of equal ones the first in order."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("class")))
    return members(rows).groupBy("cluster").agg(best.alias("best")).select("cluster", F.col("best.class").alias("dominant_class"))


def complete_any(rows: DataFrame) -> DataFrame:
    """(cluster, is_complete): whether all rows of any one class lie in the cluster."""
    total = class_sizes(rows).withColumnRenamed("n", "total")
    return members(rows).join(total, "class").groupBy("cluster").agg(F.bool_or(F.col("n") == F.col("total")).alias("is_complete"))


def composition(rows: DataFrame) -> DataFrame:
    """(cluster, class_composition): "A:3; B:1", by class."""
    parts = F.array_sort(F.collect_list(F.struct("class", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["class"], F.lit(":"), p["n"].cast("string"))), "; ")
    return members(rows).groupBy("cluster").agg(text.alias("class_composition"))


def summary(rows: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """One row per cluster: n_elements, dominant_class, homogeneity, n_classes, class_composition, is_complete_class (of the dominant class only), and exemplar_id if exemplars (cluster, exemplar_id) are given."""
    total = class_sizes(rows).withColumnRenamed("n", "total")
    counted = members(rows).join(total, "class")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("class"), F.col("total")))
    parts = F.array_sort(F.collect_list(F.struct("class", "n")))
    out = counted.groupBy("cluster").agg(F.sum("n").alias("n_elements"), best.alias("best"), F.count("*").alias("n_classes"), parts.alias("parts"))
    out = out.select(
        F.col("cluster").alias("cluster_id"), "n_elements", F.col("best.class").alias("dominant_class"), (-F.col("best.m") / F.col("n_elements")).alias("homogeneity"), "n_classes",
        F.array_join(F.transform("parts", lambda p: F.concat(p["class"], F.lit(":"), p["n"].cast("string"))), "; ").alias("class_composition"),
        (-F.col("best.m") == F.col("best.total")).alias("is_complete_class"),
    )
    return out if exemplars is None else out.join(exemplars.withColumnRenamed("cluster", "cluster_id"), "cluster_id", "left")


def observed_minimum(rows: DataFrame) -> DataFrame:
    """The least homogeneity and size of any cluster."""
    per = members(rows).groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("h"), F.sum("n").alias("n"))
    return per.agg(F.min("h").alias("min_homogeneity"), F.min("n").alias("min_size"))


def segments(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions in each group: by, segment_start, segment_end, n. A run of one appears once."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    runs = rows.select(*by, position, island.alias("island")).groupBy(*by, "island")
    return runs.agg(F.min(position).alias("segment_start"), F.max(position).alias("segment_end"), F.count("*").alias("n")).drop("island")


def pure_runs(rows: DataFrame, order: str, min_size: int = 3, by: list[str] | None = None) -> DataFrame:
    """Maximal runs of one class along ``order`` (whole numbers without gaps) of at least min_size rows: class, run_start, run_end, n."""
    by = by or []
    # rows of a class that follow each other keep the difference of their place among all and among their class
    island = F.col(order) - F.row_number().over(Window.partitionBy(*by, "class").orderBy(order))
    runs = rows.select(*by, "class", order, island.alias("island")).groupBy(*by, "class", "island")
    return runs.agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("n")).where(F.col("n") >= min_size).drop("island")
