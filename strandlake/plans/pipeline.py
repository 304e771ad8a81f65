"""The whole classification: FASTA or sequences in, clusters, motifs, model and reports out."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import kmers as K
from strandlake.operators import analysis, ap, clusters, distance, explain, linkage, ml, motifs, segment, split
from strandlake.sources import fasta

log = logging.getLogger("strandlake")


@dataclass
class Result:
    """Everything that a run made; frames are lazy."""

    sequences: DataFrame
    assignment: DataFrame
    cluster_summary: DataFrame
    profiles: DataFrame
    selection: motifs.Selection
    split: split.Split | None = None
    trained: ml.Trained | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)
    importance: DataFrame | None = None
    dendrogram: linkage.Dendrogram | None = None
    processing_time: float = 0.0

    def describe(self) -> str:
        out = [f"motifs: {len(self.selection.unique)} ({self.selection.case})"]
        if self.trained is not None:
            out.append(f"model: {self.trained.method}, accuracy {self.trained.accuracy}, kappa {self.trained.kappa}, interval {self.trained.interval}")
        return "\n".join([*out, f"seconds: {self.processing_time:.1f}"])


def bounded_sample(counts: DataFrame, limit: int, seed: int) -> DataFrame:
    """All rows of (seq_id, class, counts) if at most limit, else floor(limit / classes) of each class by a seeded hash: what stages quadratic in rows may hold."""
    sizes = counts.groupBy("class").count().collect()
    if sum(r["count"] for r in sizes) <= limit:
        return counts
    order = Window.partitionBy("class").orderBy(F.xxhash64("seq_id", F.lit(seed)), "seq_id")
    return counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit // max(1, len(sizes))).drop("k")


def by_dendrogram(spark: SparkSession, counts: DataFrame, threshold: float, min_size: int = 3, metric: str = "euclidean", method: str = "ward.D2", positional: bool = False) -> tuple[DataFrame, linkage.Dendrogram]:
    """(seq_id, class, cluster) of a bounded table of counts: linkage on the driver, then segments of the leaf order.

    Clusters are found along the leaf order and belong to the rows at those
    leaves; ``positional`` attaches them to rows by input position instead.
    """
    rows = counts.select("seq_id", "class", "counts").toArrow()
    if rows.num_rows < 2:
        raise ValueError("at least two sequences are needed")
    order = np.argsort(rows["seq_id"].to_numpy(), kind="stable")
    ids, classes = ([values[i] for i in order] for values in (rows["seq_id"].to_pylist(), rows["class"].to_pylist()))
    x = np.concatenate([part.flatten().to_numpy(zero_copy_only=False) for part in rows["counts"].chunks]).reshape(len(ids), -1)
    tree = linkage.dendrogram(x[order].astype(np.float64), classes, [str(i) for i in ids], metric, method)
    numbers = segment.assignment(tree.labels, threshold, min_size)
    place = range(len(ids)) if positional else tree.order
    return spark.createDataFrame([(ids[i], classes[i], c) for i, c in zip(place, numbers)], "seq_id long, class string, cluster int"), tree


def by_dendrogram_all(spark: SparkSession, counts: DataFrame, threshold: float, min_size: int = 3, metric: str = "euclidean", method: str = "ward.D2", seed: int = 123, limit: int = linkage.MOST) -> tuple[DataFrame, linkage.Dendrogram]:
    """by_dendrogram() for a table of any size: beyond limit, a sample of each class is linked, and every other row joins the cluster with the nearest centroid (of equal ones the first)."""
    part = bounded_sample(counts, limit, seed)
    found, tree = by_dendrogram(spark, part, threshold, min_size, metric, method)
    if part is counts:
        return found, tree
    members = part.join(found.select("seq_id", "cluster"), "seq_id").select(F.col("cluster").cast("string").alias("class"), F.col("counts").alias("x"))
    heads: dict[int, list[float]] = {}
    for r in distance.centroids(members).orderBy("class", "pos").collect():
        heads.setdefault(int(r["class"]), []).append(r["value"])
    rest = counts.join(found.select("seq_id"), "seq_id", "left_anti")
    near = distance.nearest_exemplar(rest.select(F.col("seq_id").alias("id"), F.col("counts").alias("x")), list(heads.items()), metric)
    near = rest.select("seq_id", "class").join(near.select(F.col("id").alias("seq_id"), F.col("exemplar").cast("int").alias("cluster")), "seq_id")
    return found.unionByName(near), tree


def classify(
    spark: SparkSession, source: str | DataFrame, k: int = 6, dist_method: str = "euclidean", hom_thresh: float = 0.8, n_motifs: int = 256, seq_per_class: int | None = 200, min_size: int = 800, prop_train: float = 0.7, cv_folds: int = 10,
    external_train: str | DataFrame | None = None, external_test: str | DataFrame | None = None, kmer_analysis_threshold: float = 0.0, cluster_method: str = "dendrogram", ap_r: float = 2, ml_method: str = "xgb", alphabet=K.DNA,
    hclust_method: str = "ward.D2", rounds: int = ml.ROUNDS, split_rule: str = "cap", seed: int = 123, output: str | None = None, importance: bool = True, top_n: int = 10, min_cluster_length: int | None = None, ap_rest: str = "follow",
) -> Result:
    """Run all stages.

    Sources and external sets are FASTA files or folders, or tables of sequences.
    Stages quadratic in sequences hold at most 5000 of them, a seeded sample of
    each class; every other sequence then joins the nearest cluster (dendrogram)
    or follows its class's nearest exemplar (apcluster), so that all sequences
    count in profiles and reports.  ``ap_rest`` "none" leaves rows that are no
    exemplar unclustered.  ``min_cluster_length`` keeps shorter sequences out of
    clustering.  With external sets, motifs that not both sets hold are left out.
    """
    if cluster_method not in ("dendrogram", "apcluster"):
        raise ValueError("cluster_method must be 'dendrogram' or 'apcluster'")
    began = time.time()
    seqs = fasta.read_fasta(spark, source) if isinstance(source, str) else source
    external_train, external_test = (fasta.read_fasta(spark, x) if isinstance(x, str) else x for x in (external_train, external_test))
    counts = K.count_arrays(seqs if min_cluster_length is None else split.long_enough(seqs, min_cluster_length), k, alphabet).cache()
    tree = None
    if cluster_method == "dendrogram":
        assignment, tree = by_dendrogram_all(spark, counts, hom_thresh, metric=dist_method, method=hclust_method, seed=seed)
    else:
        two = ap.two_stage(counts.select(F.col("seq_id").alias("id"), "class", F.col("counts").cast("array<double>").alias("x")), ap_r, ap_rest)
        assignment = two.select(F.col("id").alias("seq_id"), "class", "cluster").where("cluster is not null")
    assignment = assignment.cache()
    summary = clusters.summary(assignment)
    clustered = seqs.join(assignment.select("seq_id", "cluster"), "seq_id")
    profiles = motifs.cluster_profiles(clustered, k, alphabet).withColumn("cluster", F.col("cluster").cast("int")).cache()
    n_classes = assignment.select("class").distinct().count()
    selection = motifs.select_motifs(profiles, summary, n_motifs, n_classes)
    out = Result(seqs, assignment, summary, profiles, selection, dendrogram=tree)
    out.reports = {
        "unique_cluster_motifs": analysis.unique_cluster_motifs(profiles, summary, kmer_analysis_threshold),
        "cluster_frequency": analysis.cluster_frequency(profiles, kmer_analysis_threshold),
        "class_frequency": analysis.class_frequency(profiles, summary, kmer_analysis_threshold),
        "unique_class_motifs": analysis.unique_class_motifs(profiles, summary, kmer_analysis_threshold),
    }
    if selection.unique:
        out.split = split.select_train_test(seqs, seq_per_class, min_size, prop_train, external_train, external_test, k, split_rule, seed)
        vocabulary = K.all_kmers(alphabet, k)
        chosen = selection.unique
        if external_test is not None:
            common = split.align_kmers(K.count_by_class(out.split.train, k, alphabet), K.count_by_class(out.split.test, k, alphabet))
            common = {r[0] for r in common.where(F.col("kmer").isin(chosen)).collect()}
            chosen = [x for x in chosen if x in common]

        def features(rows: DataFrame) -> DataFrame:
            return ml.motif_features(K.count_arrays(rows, k, alphabet), vocabulary, chosen)[0]

        train_rows = features(out.split.train)
        out.trained = ml.train(train_rows, features(out.split.test), chosen, ml_method, cv_folds, rounds, seed=seed)
        if importance:
            out.importance = explain.feature_importance(spark, out.trained, top_n)
        if output:
            fasta.save_checkpoint({"train": out.split.train, "test": out.split.test, "assignment": assignment, "profiles": profiles}, output)
            fasta.save_model(out.trained.model, f"{output}/model")
    out.processing_time = time.time() - began
    log.info("done in %.1f s", out.processing_time)
    return out
