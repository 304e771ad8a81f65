"""k-mer specificity reports over cluster profiles and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def presence(profiles: DataFrame, threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """Rows whose value exceeds the threshold. With norm and 0, a cluster's rarest k-mer counts as absent; with raw, only uncounted ones do."""
    return profiles.where(F.col(value) > threshold)


def unique_cluster_motifs(profiles: DataFrame, clusters: DataFrame, threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """(ord, motif, cluster, class, value) of k-mers that are present in exactly one cluster."""
    present = presence(profiles, threshold, value)
    one = present.groupBy("ord", "kmer").agg(F.count("*").alias("n"), F.min("cluster").alias("cluster"), F.min(value).alias("value")).where("n = 1")
    label = clusters.select(F.col("cluster_id").alias("cluster"), F.col("dominant_class").alias("class"))
    return one.join(label, "cluster").select("ord", F.col("kmer").alias("motif"), "cluster", "class", "value")


def cluster_frequency(profiles: DataFrame, threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """(ord, kmer, n_clusters, rank): in how many clusters each k-mer is present, most first, ties in vocabulary order."""
    counted = profiles.groupBy("ord", "kmer").agg(F.count_if(F.col(value) > threshold).alias("n_clusters"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_clusters"), "ord")))


def class_frequency(profiles: DataFrame, clusters: DataFrame, threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """(ord, kmer, class, n): in how many clusters of a class each k-mer is present; long form, zeros included."""
    label = clusters.select(F.col("cluster_id").alias("cluster"), F.col("dominant_class").alias("class"))
    return profiles.join(label, "cluster").groupBy("ord", "kmer", "class").agg(F.count_if(F.col(value) > threshold).alias("n"))


def class_frequency_matrix(profiles: DataFrame, clusters: DataFrame, classes: list[str], threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """class_frequency() with a column per class and Total."""
    wide = class_frequency(profiles, clusters, threshold, value).groupBy("ord", "kmer").pivot("class", classes).agg(F.sum("n"))
    wide = wide.fillna(0, subset=classes)
    total: Column = F.lit(0)
    for c in classes:
        total = total + F.col(f"`{c}`")
    return wide.withColumn("Total", total)


def unique_class_motifs(profiles: DataFrame, clusters: DataFrame, threshold: float = 0.0, value: str = "norm") -> DataFrame:
    """(ord, motif, class, n_clusters_with_motif, total_class_clusters) of k-mers that are present in clusters of exactly one class."""
    label = clusters.select(F.col("cluster_id").alias("cluster"), F.col("dominant_class").alias("class"))
    total = label.groupBy("class").agg(F.count("*").alias("total_class_clusters"))
    present = presence(profiles, threshold, value).join(label, "cluster")
    one = present.groupBy("ord", "kmer").agg(F.min("class").alias("class"), F.max("class").alias("last"), F.count("*").alias("n_clusters_with_motif")).where("class = last")
    return one.join(total, "class").select("ord", F.col("kmer").alias("motif"), "class", "n_clusters_with_motif", "total_class_clusters")


def motif_rank(counts: DataFrame) -> DataFrame:
    """Sums and carriers per class and k-mer, from counts (seq_id, class, ord, kmer, n).

    (ord, kmer, class, shown, mean): shown is "sum|carriers", the sum padded with
    zeros to the width of the largest; mean is the average of a k-mer's class sums
    over all classes, to two places.
    """
    sums = counts.groupBy("ord", "kmer", "class").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("carriers"))
    held = F.map_from_entries(F.collect_list(F.struct("class", F.struct("total", "carriers")))).alias("held")
    per = sums.groupBy("ord", "kmer").agg(held, F.sum("total").alias("all_total")).withColumn("all", F.lit(1))
    # one row: the classes, and the width of the largest sum
    head = sums.agg(F.array_sort(F.collect_set("class")).alias("names"), F.length(F.greatest(F.max("total"), F.lit(0)).cast("string")).alias("width")).withColumn("all", F.lit(1))
    full = per.join(head, "all").select("ord", "kmer", "held", "width", F.round(F.col("all_total") / F.size("names"), 2).alias("mean"), F.explode("names").alias("class"))
    cell = F.coalesce(F.try_element_at("held", F.col("class")), F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("carriers")))
    shown = F.concat(F.lpad(cell["total"].cast("string"), F.col("width"), F.lit("0")), F.lit("|"), cell["carriers"].cast("string"))
    return full.select("ord", "kmer", "class", shown.alias("shown"), "mean")


def test_unique_class_motifs(counts: DataFrame) -> DataFrame:
    """(ord, motif, class, total) of k-mers that sequences of exactly one class hold, from class counts (class, ord, kmer, n)."""
    some = counts.where("n > 0").groupBy("ord", "kmer").agg(F.min("class").alias("class"), F.max("class").alias("last"), F.sum("n").alias("total"))
    return some.where("class = last").select("ord", F.col("kmer").alias("motif"), "class", "total")


def test_class_frequency(counts: DataFrame) -> DataFrame:
    """(ord, kmer, n_classes): how many classes hold each k-mer, from class counts."""
    return counts.groupBy("ord", "kmer").agg(F.count_if(F.col("n") > 0).alias("n_classes"))
