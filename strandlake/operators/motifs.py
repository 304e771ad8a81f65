"""Cluster motifs: summed and min-max normalised k-mer profiles, and the selection of motifs without replacement."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.kmers import DNA, count_by_class, zero_fill


def cluster_profiles(seqs: DataFrame, k: int = 6, alphabet=DNA, by: str = "cluster") -> DataFrame:
    """(by, ord, kmer, raw, norm) for every k-mer of the vocabulary in every group of seqs; rows without a group take no part.

    raw is the group's summed count, zeros included; norm = (raw - min) / (max -
    min) over the group's k-mers, 0.5 if all are equal.
    """
    some = seqs.where(F.col(by).isNotNull())
    counts = zero_fill(count_by_class(some, k, alphabet, by), by, alphabet, k)
    return normalise(counts.withColumnRenamed("n", "raw"), by)


def normalise(raw: DataFrame, by: str) -> DataFrame:
    """Adds norm to (by, ord, kmer, raw); the limits come from a small aggregate, so no task holds a whole group."""
    limits = raw.groupBy(by).agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    norm = F.when(F.col("high") == F.col("low"), F.lit(0.5)).otherwise((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")))
    return raw.join(limits, by).select(by, "ord", "kmer", "raw", norm.alias("norm"))


def class_scores(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(class, ord, kmer, score): norms summed over the clusters that a class dominates."""
    dominated = clusters.select(F.col("cluster_id").alias("cluster"), F.col("dominant_class").alias("class"))
    return profiles.join(dominated, "cluster").groupBy("class", "ord", "kmer").agg(F.sum("norm").alias("score"))


def ranked(scores: DataFrame, by: str, score: str, limit: int) -> DataFrame:
    """The first ``limit`` k-mers of each group by score, ties in vocabulary order: all that a selection of ``limit`` motifs can reach."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "ord")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def quotas(names: list[str], n: int) -> dict[str, int]:
    """n dealt evenly; the first n mod len(names) get one more."""
    each, more = divmod(n, len(names))
    return {name: each + (i < more) for i, name in enumerate(names)}


@dataclass
class Selection:
    """Motifs by class, in the order of picks, and how they were chosen."""

    motifs: dict[str, list[str]] = field(default_factory=dict)
    n: int = 0
    k: int = 0
    m: int = 0
    case: str = ""
    reason: str = ""
    dropped_clusters: list = field(default_factory=list)

    @property
    def unique(self) -> list[str]:
        return list(dict.fromkeys(x for v in self.motifs.values() for x in v))

    @property
    def motifs_per_class(self) -> dict[str, int]:
        return {c: len(v) for c, v in self.motifs.items()}

    def rows(self) -> list[tuple[str, int, str]]:
        return [(c, i + 1, x) for c, v in self.motifs.items() for i, x in enumerate(v)]


def _take(ranking: list[str], used: set[str], n: int) -> list[str]:
    out = []
    for name in ranking:
        if len(out) == n:
            break
        if name not in used:
            used.add(name)
            out.append(name)
    return out


def pick_by_class(rankings: dict[str, list[str]], n: int) -> dict[str, list[str]]:
    """Classes in order take their quota of the best k-mers that none before them took."""
    used: set[str] = set()
    return {c: _take(rankings[c], used, q) for c, q in quotas(list(rankings), n).items()}


def pick_by_cluster(rankings: dict, n: int, dominant: dict, homogeneity: dict, class_rankings: dict[str, list[str]] | None = None, extra: str = "homogeneity") -> dict[str, list[str]]:
    """Clusters in order of id take n div m of their best unused k-mers each.

    The remainder goes, one each, to the least homogeneous clusters (extra =
    "homogeneity"), or round-robin over the classes by summed score ("class").
    """
    ids = sorted(rankings)
    used: set[str] = set()
    out: dict[str, list[str]] = {c: [] for c in sorted(set(dominant.values()))}
    each, rest = divmod(n, len(ids))
    for i in ids:
        out[dominant[i]] += _take(rankings[i], used, each)
    if extra == "homogeneity":
        for i in sorted(ids, key=lambda i: (homogeneity.get(i, 0.0), ids.index(i)))[:rest]:
            out[dominant[i]] += _take(rankings[i], used, 1)
    else:
        names = list(out)
        for j in range(rest):
            c = names[j % len(names)]
            out[c] += _take((class_rankings or {}).get(c, []), used, 1)
    return out


def select_motifs(profiles: DataFrame, clusters: DataFrame, n: int = 256, n_classes: int | None = None, extra: str = "homogeneity") -> Selection:
    """Choose n different motifs in all.

    profiles is (cluster, ord, kmer, norm), clusters (cluster_id, dominant_class,
    homogeneity). With m clusters in both and k classes: n < k selects nothing
    (CASE_1); k <= n < m goes by class scores (CASE_2); n >= m by cluster (CASE_3).
    Spark ranks the k-mers; as each pick takes one k-mer, the first n of a ranking
    suffice, and that many rows per cluster come to the driver.
    """
    n = int(n)
    have = {r[0] for r in profiles.select("cluster").distinct().collect()}
    info = {r["cluster_id"]: r for r in clusters.collect()}
    dropped = sorted(set(info) - have)
    info = {i: r for i, r in info.items() if i in have}
    m = len(info)
    dominant = {i: r["dominant_class"] for i, r in info.items()}
    classes = sorted(set(dominant.values()))
    k = len(classes) if n_classes is None else n_classes
    base = {"n": n, "k": k, "m": m, "dropped_clusters": dropped}
    if n < k or not m:
        return Selection(case="CASE_1", reason=f"n ({n}) is less than the number of classes ({k})", **base)

    def rankings(df: DataFrame, by: str, score: str) -> dict:
        out: dict = {}
        for name, _, kmer in sorted(tuple(r) for r in ranked(df, by, score, n).select(by, "rank", "kmer").collect()):
            out.setdefault(name, []).append(kmer)
        return out

    some = profiles.where(F.col("cluster").isin(list(info)))
    if n < m:
        return Selection(pick_by_class(dict(sorted(rankings(class_scores(some, clusters), "class", "score").items())), n), case="CASE_2", **base)
    by_class = rankings(class_scores(some, clusters), "class", "score") if extra == "class" else None
    homogeneity = {i: r["homogeneity"] if "homogeneity" in r.asDict() else 0.0 for i, r in info.items()}
    return Selection(pick_by_cluster(rankings(some, "cluster", "norm"), n, dominant, homogeneity, by_class, extra), case="CASE_3", **base)
