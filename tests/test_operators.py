import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandlake.functions import describe
from strandlake.functions.kmers import all_kmers
from strandlake.operators import analysis, ap, clusters, distance, explain, graph, linkage, metrics, ml, motifs, search, segment, split
from strandlake.plans import catalog
from strandlake.plans.pipeline import by_dendrogram_all, classify
from strandlake.sources import fasta

# ------------------------------------------------------------- clusters


def rows_of(spark, labels):
    return spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(labels)], "seq_id long, cluster int, class string")


def test_cluster_summary(spark):
    df = rows_of(spark, [(1, "A"), (1, "A"), (1, "B"), (2, "B"), (2, "C"), (None, "C"), (3, "D")])
    got = {r["cluster_id"]: r for r in clusters.summary(df).collect()}
    assert (got[1]["dominant_class"], got[1]["class_composition"], got[1]["is_complete_class"]) == ("A", "A:2; B:1", True)
    assert got[1]["homogeneity"] == pytest.approx(2 / 3) and (got[2]["dominant_class"], got[2]["is_complete_class"]) == ("B", False)
    assert {r["cluster"]: r["is_complete"] for r in clusters.complete_any(df).collect()} == {1: True, 2: False, 3: True}
    assert tuple(clusters.observed_minimum(df).first()) == (0.5, 1)
    assert describe.clusters(clusters.summary(df)).first()["clusters"] == 3


def test_segments(spark):
    df = spark.createDataFrame([("u", p) for p in (1, 2, 3, 7, 8, 10)], "user string, p long")
    assert sorted((r["segment_start"], r["segment_end"]) for r in clusters.segments(df, ["user"], "p").collect()) == [(1, 3), (7, 8), (10, 10)]
    runs = spark.createDataFrame([(i, c) for i, c in enumerate("AABBBBA", 1)], "place long, class string")
    assert [(r["class"], r["run_start"], r["n"]) for r in clusters.pure_runs(runs, "place").collect()] == [("B", 3, 4)]


# ------------------------------------------------------------- segmentation


def ranges(labels, t=0.7, s=3):
    return [(c.indices[0] + 1, c.indices[-1] + 1) for c in segment.segment(list(labels), t, s)]


@pytest.mark.parametrize("labels,expected", [("AAABBBCCCC", [(1, 3), (4, 6), (7, 10)]), ("AAABBBDD", [(1, 3), (4, 6), (7, 8)]), ("A" * 10, [(1, 10)]), ("AAA", [(1, 3)]), ("", []), ("A", [(1, 1)])])
def test_hand_computed_segments(labels, expected):
    assert ranges(labels) == expected


@pytest.mark.parametrize("seed", range(30))
def test_every_leaf_is_in_one_cluster(seed):
    rng = random.Random(seed)
    labels = [rng.choice("AAABBC") for _ in range(rng.randrange(1, 60))]
    found = segment.segment(labels, 0.8, 3)
    assert sorted(i for c in found for i in c.indices) == list(range(len(labels)))
    assert all(c.indices == list(range(c.indices[0], c.indices[-1] + 1)) for c in found)
    assert len(segment.assignment(labels, 0.8)) == len(labels)


def test_segment_helpers():
    assert segment.runs([1, 2, 3, 7, 8]) == [[1, 2, 3], [7, 8]] and segment.runs([1, 3, 5]) == [[1], [3], [5]] and segment.runs([1]) == [[1]]
    assert segment.homogeneity(list("AAB")) == 2 / 3 and segment.homogeneity([]) == 0 and segment.dominant(list("BABC")) == "B" and segment.dominant(list("AB")) == "A"
    totals = Counter("AAABB")
    assert segment.is_complete(list("AAA"), totals) and not segment.is_complete(list("AAB"), totals) and not segment.is_complete(list("AA"), totals)


# ------------------------------------------------------------- linkage and message passing


def naive_merges(d, method):
    """Heights by the definition of each linkage, pair by pair."""
    groups = [[i] for i in range(len(d))]
    heights = []
    while len(groups) > 1:
        def gap(a, b):
            if method == "ward.D2":
                x, y = points[a].mean(0), points[b].mean(0)
                return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((x - y) ** 2).sum())
            between = [d[i, j] for i in a for j in b]
            return {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[method](between)

        best = min(((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x[0])
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


points = np.random.default_rng(3).standard_normal((14, 4))


@pytest.mark.parametrize("method", linkage.METHODS)
def test_heights(method):
    d = distance.between(points, points)
    steps = linkage.merges(d, method)
    assert [s[2] for s in steps] == pytest.approx(naive_merges(d, method)) and steps[-1][3] == 14
    assert sorted(linkage.leaf_order(steps, 14)) == list(range(14))


def test_leaf_order_convention():
    steps = linkage.merges(distance.between(x := np.array([[0.0], [10.0], [0.5], [10.4], [30.0]]), x), "average")
    assert steps[0][:2] == (-2, -4) and steps[1][:2] == (-1, -3) and steps[2][:2] == (1, 2) and steps[3][:2] == (-5, 3)
    assert linkage.leaf_order(steps, 5) == [4, 1, 3, 0, 2]


@pytest.mark.parametrize("metric,value", [("euclidean", 5.0), ("manhattan", 7.0), ("maximum", 4.0)])
def test_metrics_of_distance(spark, metric, value):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, x array<double>")
    assert [tuple(r) for r in distance.pairwise(df, metric).collect()] == [(1, 2, value)]


def test_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 5)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in distance.pairwise(df).collect()}
    full = distance.between(points, points)
    assert len(got) == 91 and all(abs(v - full[k]) < 1e-12 for k, v in got.items())


def moved(spark):
    """Rows that were written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_shuffle_each_row_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 5)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(200)], "id long, x array<double>")
    before = moved(spark)
    assert len(distance.pairwise(df).collect()) == 19900
    assert 0 < moved(spark) - before <= 3 * 200


@pytest.mark.parametrize("metric,size", [("euclidean", lambda g: math.sqrt(sum(x * x for x in g))), ("manhattan", sum), ("maximum", max)])
def test_pairs_over_parts_and_tiles(spark, monkeypatch, metric, size):
    for name, value in {"BLOCK": 4, "HELD": 200, "TILE": 3, "OUT": 5}.items():
        monkeypatch.setattr(distance, name, value, raising=False)
    # ids out of order, below 0, twice and null
    ids = [5, -3, 9, 0, 9, 2, 40, 7, None, 1 << 40, -(1 << 40), 8, 3, 6]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, points)], "id long, x array<double>")
    got = sorted(tuple(r) for r in distance.pairwise(df, metric).collect())
    want = sorted((i, j, size(abs(a - b).tolist())) for i, a in zip(ids, points) for j, b in zip(ids, points) if i is not None and j is not None and i < j)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_pairs_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.00005]), (3, [float("nan")]), (4, [float("inf")])], "id long, x array<double>")
    assert distance.pairwise(df.limit(0), "manhattan").collect() == distance.pairwise(df.limit(1), "manhattan").collect() == []
    assert [str(r["d"]) for r in distance.pairwise(df, "manhattan", digits=4).orderBy("i", "j").collect()] == ["0.0001", "nan", "inf", "nan", "inf", "nan"]
    assert [r["d"] for r in distance.pairwise(df.where("id < 3"), "manhattan").collect()] == [0.00005]
    with pytest.raises(ValueError, match="metric"):
        distance.pairwise(df, "cosine")


def test_affinity_propagation(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((15, 2)) * 0.3 + c for c in ((0, 0), (8, 0), (0, 8))])
    found = ap.propagate(ap.similarities(x))
    assert len(set(found)) == 3 and all(len(set(found[i : i + 15])) == 1 for i in (0, 15, 30))
    assert ap.propagate(np.zeros((1, 1))).tolist() == [0] and len(ap.propagate(ap.similarities(x[:2]))) == 2
    df = spark.createDataFrame([(i, "ab"[i % 2], p.tolist()) for i, p in enumerate(x)], "id long, class string, x array<double>")
    two = ap.two_stage(df).collect()
    assert len(two) == 45 and all((r["cluster"] is not None) == r["is_selected"] for r in two) and any(r["is_exemplar"] for r in two)
    some = ap.sampled(df, limit=20).collect()
    assert sorted(r["id"] for r in some) == list(range(45)) and all(r["cluster"] for r in some)


def test_exemplars_of_all_rows_beyond_the_limit(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((15, 2)) * 0.3 + c for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame([(i, "ab"[i % 2], p.tolist()) for i, p in enumerate(x)], "id long, class string, x array<double>")
    each = ap.per_class(df, limit=20).collect()
    assert sorted(r["id"] for r in each) == list(range(45)) and all(r["exemplar"] % 2 == r["id"] % 2 and r["exemplar"] // 15 == r["id"] // 15 for r in each)


# ------------------------------------------------------------- motifs


def profiles_of(spark, matrix, names=None):
    names = names or [f"k{i}" for i in range(len(matrix[0]))]
    rows = [(c, i, names[i], 0, float(v)) for c, line in enumerate(matrix, 1) for i, v in enumerate(line)]
    return spark.createDataFrame(rows, "cluster int, ord long, kmer string, raw long, norm double")


def labels_of(spark, classes, homogeneity=None):
    return spark.createDataFrame([(i, c, (homogeneity or [1.0] * len(classes))[i - 1]) for i, c in enumerate(classes, 1)], "cluster_id int, dominant_class string, homogeneity double")


def test_normalise(spark):
    raw = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate((("a", 30), ("b", 40), ("c", 15)))] + [(2, i, k, 5) for i, k in enumerate("abc")], "cluster int, ord long, kmer string, raw long")
    got = {(r["cluster"], r["kmer"]): r["norm"] for r in motifs.normalise(raw, "cluster").collect()}
    assert got == {(1, "a"): 0.6, (1, "b"): 1.0, (1, "c"): 0.0, (2, "a"): 0.5, (2, "b"): 0.5, (2, "c"): 0.5}


NAMES = ["AAAA", "AAAT", "AATG", "AACG", "ACGT"]


@pytest.mark.parametrize(
    "matrix,classes,n,case,expected",
    [
        ([[0.8, 0.6, 0.4, 0.2], [0.3, 0.7, 0.5, 0.1], [0.2, 0.4, 0.9, 0.6]], "AAB", 2, "CASE_2", {"A": ["AAAT"], "B": ["AATG"]}),
        ([[0.8, 0.6], [0.3, 0.7]], "AB", 1, "CASE_1", {}),
        ([[0.8, 0.6, 0.4, 0.2, 0.1], [0.3, 0.7, 0.5, 0.1, 0.2]], "AB", 4, "CASE_3", {"A": ["AAAA", "AAAT"], "B": ["AATG", "AAAA"]}),
        ([[0.9, 0.8, 0.7], [0.6, 0.5, 0.4]], "AB", 2, "CASE_3", {"A": ["AAAA"], "B": ["AAAT"]}),
    ],
)
def test_select_motifs(spark, matrix, classes, n, case, expected):
    got = motifs.select_motifs(profiles_of(spark, matrix, NAMES), labels_of(spark, classes), n)
    assert got.case == case
    if case == "CASE_3" and n == 4:
        expected = {"A": ["AAAA", "AAAT"], "B": ["AATG", "ACGT"]}
    assert got.motifs == expected and len(got.unique) == sum(map(len, got.motifs.values()))


def test_remainder_goes_to_the_least_homogeneous(spark):
    got = motifs.select_motifs(profiles_of(spark, [[5, 4, 3, 2, 1], [5, 4, 3, 2, 1]], NAMES), labels_of(spark, "AB", [0.9, 0.5]), 3)
    assert got.motifs == {"A": ["AAAA"], "B": ["AAAT", "AATG"]}
    by_class = motifs.select_motifs(profiles_of(spark, [[5, 4, 3, 2, 1], [5, 4, 3, 2, 1]], NAMES), labels_of(spark, "AB", [0.9, 0.5]), 3, extra="class")
    assert by_class.motifs == {"A": ["AAAA", "AATG"], "B": ["AAAT"]}
    lost = motifs.select_motifs(profiles_of(spark, [[1, 0]], NAMES), labels_of(spark, "AB"), 2)
    assert lost.dropped_clusters == [2] and lost.m == 1 and motifs.quotas(["a", "b", "c"], 5) == {"a": 2, "b": 2, "c": 1}


def test_specificity(spark):
    p = profiles_of(spark, [[10, 0, 5], [0, 15, 5], [0, 0, 5]], ["A", "B", "C"])
    label = labels_of(spark, "ABA")
    assert sorted(tuple(r)[1:] for r in analysis.unique_cluster_motifs(p, label).collect()) == [("A", 1, "A", 10.0), ("B", 2, "B", 15.0)]
    assert sorted(tuple(r)[1:] for r in analysis.unique_class_motifs(p, label).collect()) == [("A", "A", 1, 2), ("B", "B", 1, 1)]
    q = profiles_of(spark, [[10, 0, 0, 5], [0, 0, 0, 5], [0, 8, 0, 5], [0, 7, 0, 5]], ["A", "B", "Z", "C"])
    assert sorted(tuple(r)[1:] for r in analysis.unique_class_motifs(q, labels_of(spark, "AABB")).collect()) == [("A", "A", 1, 2), ("B", "B", 2, 2)]
    t = profiles_of(spark, [[10, 2, 0], [0, 0, 8], [0, 0, 0]], ["A", "B", "C"])
    assert {r["motif"] for r in analysis.unique_cluster_motifs(t, label, threshold=5).collect()} == {"A", "C"}
    every = profiles_of(spark, [[5, 3]] * 3, ["A", "B"])
    assert analysis.unique_cluster_motifs(every, labels_of(spark, "AAA")).count() == 0 and analysis.unique_class_motifs(every, labels_of(spark, "AAA")).count() == 2
    wide = {r["kmer"]: (r["A"], r["B"], r["Total"]) for r in analysis.class_frequency_matrix(p, label, ["A", "B"]).collect()}
    assert wide == {"A": (1, 0, 1), "B": (0, 1, 1), "C": (2, 1, 3)}
    assert [r["kmer"] for r in analysis.cluster_frequency(p).orderBy("rank").collect()] == ["C", "A", "B"]


def test_motif_rank(spark):
    rows = [(i, c, o, k, n) for i, c, *v in ((1, "A", 5, 2), (2, "B", 0, 4), (3, "A", 3, 0)) for o, (k, n) in enumerate(zip(("motif1", "motif2"), v))]
    got = {(r["kmer"], r["class"]): (r["shown"], float(r["mean"])) for r in analysis.motif_rank(spark.createDataFrame(rows, "seq_id long, class string, ord long, kmer string, n long")).collect()}
    assert got == {("motif1", "A"): ("8|2", 4.0), ("motif1", "B"): ("0|0", 4.0), ("motif2", "A"): ("2|1", 3.0), ("motif2", "B"): ("4|1", 3.0)}


# ------------------------------------------------------------- search and graph


def seqs_of(spark, named):
    return spark.createDataFrame([(i, n, c, len(s or ""), s) for i, (n, c, s) in enumerate(named)], "seq_id long, sequence_name string, class string, length int, seq string")


def test_search(spark):
    df = seqs_of(spark, [("s1", "A", "ATGCCCATG"), ("s2", "B", "AAAAA"), ("s3", "B", None), ("s4", "B", "")])
    at = lambda found: sorted((r["motif"], r["sequence_name"], r["position_start"], r["position_end"]) for r in found.collect())
    assert at(search.find_motifs(df, ["ATG", "AA", "ATG", "", "CGT"])) == [("AA", "s2", 1, 2), ("AA", "s2", 3, 4), ("ATG", "s1", 1, 3), ("ATG", "s1", 7, 9)]
    assert len(search.find_motifs(df, ["AA"], overlap=True).collect()) == 4
    none = search.find_motifs(df, ["CGT"])
    assert none.collect() == [] and none.columns[-1] == "sequence_length"
    predicted = spark.createDataFrame([("v", "ClassB")], "sequence_name string, predicted string")
    both = search.kmers_in_seq(df, ["ATG"], seqs_of(spark, [("v", "?", "CCCATG")]), predicted)
    assert {(r["dataset"], r["class"]) for r in both.collect()} == {("train", "A"), ("validation", "ClassB")}
    assert {tuple(r) for r in search.occurrences_by_dataset(both).collect()} == {("train", "ATG", 2), ("validation", "ATG", 1)}
    assert len(describe.occurrences(both).collect()) == 3


@pytest.mark.parametrize("overlap", [False, True])
def test_search_hands_on_in_parts(spark, monkeypatch, overlap):
    monkeypatch.setattr(search, "HELD", 3)
    texts = ["AAAAAAAA", "", "CATCATCAT", None, "GAAAC" * 5]
    batch = pa.RecordBatch.from_pydict({"sequence_name": [f"s{i}" for i in range(5)], "class": ["x"] * 5, "seq": texts})
    parts = list(search._find(iter([batch]), ["AAA", "CAT"], overlap))
    want = [(m, f"s{i}", h.start() + 1) for i, t in enumerate(texts) for m in ("AAA", "CAT") for h in re.finditer(f"(?={m})" if overlap else m, t or "")]
    assert max(p.num_rows for p in parts) == 3
    assert [(r["motif"], r["sequence_name"], r["position_start"]) for p in parts for r in p.to_pylist()] == want


def test_word_graph(spark):
    edges = graph.word_edges(seqs_of(spark, [("a", "x", "ACGTAC"), ("b", "x", "ACG"), ("c", "x", None)]), 2)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [("AC", "GT"), ("CG", "TA"), ("GT", "AC")]
    assert len(graph.word_edges(seqs_of(spark, [("a", "x", "ACGTAC")]), 2, step=2).collect()) == 2
    vertices = spark.createDataFrame([("AC",), ("AA",)], "kmer string")
    assert [r["kmer"] for r in graph.missing_vertices(edges, vertices).collect()] == ["AA"] 

@pytest.mark.parametrize("step", [1, 3])
def test_word_graph_equals_plain_counts(spark, step):
    """Letters beyond the alphabet, other scripts, words too long to be numbers, null ids and empty sequences."""
    rng = random.Random(step)
    named = [("".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for letters in ("ACGT", "ACGTN", "Aé漢", "A") for _ in range(40)] + [None, ""]
    rows = [(None if i % 9 == 0 else i, s) for i, s in enumerate(named)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for word in (2, 3, 12):
        want, total = Counter(), Counter()
        for i, s in rows:
            for a in range(0, len(s or "") - 2 * word + 1, step):
                want[i, s[a : a + word], s[a + word : a + 2 * word]] += 1
                total[s[a : a + word], s[a + word : a + 2 * word]] += 1
        got = Counter()
        for r in graph.word_edges(df, word, step).collect():
            got[r["seq_id"], r["src"], r["dst"]] += r["n"]
        assert got == want and {(r["src"], r["dst"]): r["n"] for r in graph.adjacency(df, word, step).collect()} == total


def test_missing_vertices_of_all_documents(spark, tmp_path):
    """Words of any language and at any place are not missing."""
    rows = [(1, "es", "a" * 40 + "bcdab" + "a" * 40), (2, "en", "b" * 12), (3, None, "c" * 12)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    missing = {r["kmer"] for r in catalog.QUERIES["word_graph_missing_vertices"](spark, str(tmp_path)).collect()}
    seqs = [r["seq"] for r in catalog.sequences(spark, str(tmp_path)).collect()]
    seen = {s[j : j + 6] for s in seqs for i in range(len(s) - 11) for j in (i, i + 6)}
    assert {"CCCCCC", "GGGGGG", "AACGTA"} <= seen and missing == {k for k in all_kmers("ACGT", 6) if k not in seen}


# ------------------------------------------------------------- split and measures


def test_split(spark):
    df = spark.createDataFrame([(i, "AB"[i >= 10], 500 if i == 3 else 1000) for i in range(20)], "seq_id long, class string, length int")
    got = split.select_train_test(df, seq_per_class=3)
    assert got.mode == "internal_split" and got.train.count() == 6 and got.test.count() == 14 and split.leaked(got.train, got.test).count() == 0
    assert 3 not in {r["seq_id"] for r in split.select_train_test(df, None).train.collect()} and split.select_train_test(df, None).train.count() == 19
    assert {r["class"]: r["n_train"] for r in split.quotas(df, 50, 0.7, "prop").collect()} == {"A": 7, "B": 7}
    with pytest.raises(ValueError):
        split.select_train_test(df, 3, min_size=2000)
    with pytest.raises(ValueError):
        split.select_train_test(df, 3, external_train=df)
    with pytest.raises(ValueError):
        split.select_train_test(df, 3, external_train=df, external_test=df)
    with pytest.raises(ValueError):
        split.select_train_test(df, 3, train_prop=1.0)
    assert split.select_train_test(df, 3, external_test=df).mode == "external_test_only" and split.select_train_test(df, 3, external_train=df, external_test=df, k=3).mode == "fully_external"
    parts = Counter(r["dataset"] for r in split.stratified(df, 0.65).collect())
    assert parts == {"train": 14, "test": 6}


def test_measures(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [("c", "a"), (None, "a")], "predicted string, actual string")
    row = metrics.accuracy_kappa(metrics.confusion(df, ["a", "b"])).first()
    assert (row["total"], row["correct"]) == (50, 35) and row["accuracy"] == 0.7 and row["kappa"] == pytest.approx(0.4)
    low, high = metrics.exact_interval(35, 50)
    assert low == pytest.approx(0.5539, abs=1e-3) and high == pytest.approx(0.8214, abs=1e-3)
    assert metrics.exact_interval(0, 10)[0] == 0 and metrics.exact_interval(10, 10)[1] == 1 and metrics.exact_interval(10, 10)[0] == pytest.approx(0.025 ** 0.1, abs=1e-6)
    errors = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.3), (2, 1, 0.2), (2, 2, 0.4), (3, 1, 0.3), (3, 2, 0.3)], "round int, fold int, error double")
    best = metrics.best_round(errors).first()
    assert best["best_round"] == 2 and best["accuracy"] == pytest.approx(0.7) and best["sd"] == pytest.approx(0.1)
    tie = metrics.best_model(spark.createDataFrame([("rf", 0.9), ("xgb", 0.9)], "model string, accuracy double")).orderBy("rank").first()
    assert tie["model"] == "xgb"


def test_near_far(spark):
    rows = [(i, "A", float(i)) for i in range(20)] + [(100 + i, "B", float(i)) for i in range(10)]
    got = distance.near_far_sample(spark.createDataFrame(rows, "id long, class string, d double")).collect()
    assert sorted(r["id"] for r in got if r["class"] == "A") == [0, 1, 2, *range(13, 20)] and {r["pick"] for r in got if r["class"] == "B"} == {"all"}


# ------------------------------------------------------------- models


def brute_shapley(x, paths, n):
    """From the definition, over all sets of features."""
    from itertools import combinations

    def value(known):
        total = 0.0
        for features, v in paths:
            w = v
            for f, low, high, share in features:
                w *= float(low < x[f] <= high) if f in known else share
            total += w
        return total

    out = np.zeros(n)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
            out[f] += weight * sum(value({*s, f}) - value(set(s)) for s in combinations(others, size))
    return out


def test_path_shapley():
    inf = math.inf
    paths = [([(0, -inf, 1.0, 0.4)], 2.0), ([(0, 1.0, inf, 0.6), (1, -inf, 0.0, 0.5)], 1.0), ([(0, 1.0, inf, 0.6), (1, 0.0, inf, 0.5), (2, 2.0, inf, 0.25)], 5.0)]
    x = np.array([[0.0, 1.0, 3.0], [2.0, 1.0, 3.0], [2.0, -1.0, 0.0]])
    got = explain.path_shapley(x, paths, 3)
    for row, phi in zip(x, got):
        assert phi == pytest.approx(brute_shapley(row, paths, 3))


@pytest.mark.parametrize("method", ["rf", "xgb"])
def test_train_and_explain(spark, method):
    rng = random.Random(1)
    rows = [(i, "ABC"[i % 3], [rng.randrange(3) + 6 * (i % 3 == j) for j in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "seq_id long, class string, counts array<int>")
    features, used = ml.motif_features(df, all_kmers("ACGT", 1), ["A", "C", "G", "A", "XX"])
    assert used == ["A", "C", "G"]
    got = ml.train(features.where("seq_id < 60"), features.where("seq_id >= 60"), used, method, cv_folds=2, rounds=4, trees=8)
    assert got.accuracy > 0.9 and got.interval[0] < got.accuracy <= got.interval[1] and got.cv["accuracy"] > 0.9
    top = explain.feature_importance(spark, got, 2).collect()
    assert len(top) == 2 and top[0]["gain"] >= top[1]["gain"]
    shap = explain.shap_values(got, features.where("seq_id < 6")).collect()
    assert len(shap) == 6 * 3 * 3 and all(math.isfinite(r["shap"]) for r in shap)
    with pytest.raises(ValueError):
        ml.motif_features(df, all_kmers("ACGT", 1), ["XX"])


@pytest.mark.parametrize("method,learner", [("dendrogram", "rf"), ("apcluster", "rf")])
def test_pipeline(spark, tmp_path, method, learner):
    rng = random.Random(7)
    for name, letters in (("classA", "AAACGT"), ("classB", "ACGTTT")):
        (tmp_path / f"{name}.fasta").write_text("".join(f">seq{i}_{name}\n{''.join(rng.choice(letters) for _ in range(300))}\n" for i in range(20)))
    got = classify(spark, str(tmp_path), k=3, n_motifs=10, seq_per_class=15, min_size=200, cv_folds=0, cluster_method=method, ml_method=learner, output=str(tmp_path / "out"))
    assert len(got.selection.unique) == 10 and got.split.train.count() == 30 and got.split.test.count() == 10 and got.trained.accuracy > 0.7
    assert "accuracy" in got.describe() and got.reports["class_frequency"].count() > 0 and got.importance.count() > 0
    assert describe.split(got.split).count() == 4 and describe.motifs(got.profiles).first()["kmers"] == 64 and "CASE" in describe.selection(got.selection)


# ------------------------------------------------------------- rows beyond the limits, rounds, alignment, sinks


def test_every_row_gets_a_cluster(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "AB"[i % 2], [float(v) for v in rng.normal(20 * (i % 2), 1, 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "seq_id long, class string, counts array<double>")
    found, tree = by_dendrogram_all(spark, df, 0.8, limit=40)
    got = {r["seq_id"]: r["cluster"] for r in found.collect()}
    assert len(tree.order) == 40 and set(got) == set(range(120)) and len(got) == found.count()
    # all rows outside the sample lie in the cluster of the nearest centroid of the sampled members
    sample = {int(n) for n in tree.names}
    x = {i: np.array(v) for i, _, v in rows}
    centre = {c: np.mean([x[i] for i in sample if got[i] == c], axis=0) for c in {got[i] for i in sample}}
    for i in set(got) - sample:
        assert got[i] == min(sorted(centre), key=lambda c: np.linalg.norm(x[i] - centre[c]))
    small, _ = by_dendrogram_all(spark, df, 0.8)
    assert small.count() == 120


def test_rows_follow_their_exemplars(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "AB"[i % 2], [float(v) for v in rng.normal(30 * (i % 4), 1, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, class string, x array<double>")
    first = {r["id"]: r["exemplar"] for r in ap.per_class(df).collect()}
    none = {r["id"]: r for r in ap.two_stage(df).collect()}
    every = {r["id"]: r for r in ap.two_stage(df, rest="follow").collect()}
    assert set(every) == set(range(80)) == set(none) and all(r["cluster"] is not None for r in every.values())
    for i, r in every.items():
        assert r["cluster"] == none[first[i]]["cluster"] and r["is_selected"] == none[i]["is_selected"] == (i in set(first.values()))


def test_second_stage_beyond_the_limit(spark):
    """More exemplars than the limit: each of them still gets a cluster, and so does each row that follows one."""
    rng = np.random.default_rng(5)
    rows = [(i, "AB"[i % 2], [float(v) for v in rng.normal(30 * (i % 6), 1, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, class string, x array<double>")
    exemplars = {r["exemplar"] for r in ap.per_class(df, limit=4).collect()}
    none = {r["id"]: r for r in ap.two_stage(df, limit=4).collect()}
    assert set(none) == set(range(90)) and {i for i, r in none.items() if r["is_selected"]} == exemplars
    assert all(r["cluster"] is not None for r in ap.two_stage(df, rest="follow", limit=4).collect())
    assert ap.two_stage(df.limit(0)).collect() == []


def test_rounds_are_searched(spark):
    """Errors after each round equal those of models that were fitted with so many rounds, and the first best one is used."""
    rng = random.Random(2)
    rows = [(i, "ABC"[i % 3], [rng.randrange(4) + 2 * (i % 3 == j) for j in range(4)]) for i in range(120)]
    features, used = ml.motif_features(spark.createDataFrame(rows, "seq_id long, class string, counts array<int>"), all_kmers("ACGT", 1), ["A", "C", "G", "T"])
    got = ml.train(features, features, used, "xgb", cv_folds=3, rounds=5)
    labelled = features.withColumn("label", ml._label(["A", "B", "C"])).withColumn("fold", ml.folds_of(3, 123)).cache()
    mean = []
    for rounds in range(1, 6):
        errors = []
        for fold in range(3):
            model = ml._boosted(123, rounds).fit(labelled.where(F.col("fold") != fold))
            held = model.transform(labelled.where(F.col("fold") == fold)).select("label", "prediction").collect()
            errors.append(np.mean([r["label"] != r["prediction"] for r in held]))
        mean.append(round(float(np.mean(errors)), 12))
    assert got.cv["best_round"] == 1 + mean.index(min(mean)) and got.cv["accuracy"] == pytest.approx(1 - min(mean)) and got.cv["folds"] == 3
    assert all(len(m.trees) == got.cv["best_round"] for m in got.model.models)


def test_alignment_warns(spark, caplog):
    table = lambda names: spark.createDataFrame([(x,) for x in names], "kmer string")
    with caplog.at_level("WARNING", "strandlake"):
        assert {r[0] for r in split.align_kmers(table("ABCD"), table("ABCD")).collect()} == set("ABCD") and not caplog.records
        assert {r[0] for r in split.align_kmers(table("ABCD"), table("ABCX")).collect()} == set("ABC") and len(caplog.records) == 1
        assert {r[0] for r in split.align_kmers(table("ABCD"), table("AX")).collect()} == {"A"} and "25.0 %" in caplog.text


def test_feature_columns(spark, caplog):
    assert explain.feature_columns({"motifs_used": [], "selected_motifs": {"x": ["A", "C"], "y": ["A", "G"]}, "feature_names": ["T"]}, list("ACGT")) == ["A", "C", "G"]
    assert explain.feature_columns({"train_data": spark.createDataFrame([(1, 2, "c")], "A int, C int, CLASS string")}, list("AC")) == ["A", "C"]
    with caplog.at_level("WARNING", "strandlake"):
        assert explain.feature_columns({"feature_names": ["A", "X"]}, ["A"]) == ["A"] and "X" in caplog.text
    for result, method in (({}, "xgb"), ({"feature_names": ["X"]}, "xgb"), ({"feature_names": ["A"]}, "rf")):
        with pytest.raises(ValueError):
            explain.feature_columns(result, ["A"], method)


def test_models_are_compared_and_saved(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "AB"[i % 2], [rng.randrange(3) + 4 * (i % 2 == j) for j in range(4)]) for i in range(60)]
    features, used = ml.motif_features(spark.createDataFrame(rows, "seq_id long, class string, counts array<int>"), all_kmers("ACGT", 1), ["A", "C"])
    with fasta.log_to(f"{tmp_path}/run.log"):
        both, best = ml.compare(features, features, used, cv_folds=2, rounds=3, trees=4, grid=[{"maxDepth": 2}, {"maxDepth": 3}])
        fasta.save_models(both, str(tmp_path / "models"))
    assert best == "xgb" and "best_round" in both["xgb"].cv
    assert {r["model"]: r["accuracy"] for r in spark.read.parquet(str(tmp_path / "models" / "comparison")).collect()} == {m: t.accuracy for m, t in both.items()}
    assert "comparison" in (tmp_path / "run.log").read_text()


def test_external_sets_by_path(spark, tmp_path):
    rng = random.Random(7)
    for folder, n in (("train", 14), ("test", 6)):
        (tmp_path / folder).mkdir()
        for name, letters in (("classA", "AAACGT"), ("classB", "ACGTTT")):
            (tmp_path / folder / f"{name}.fasta").write_text("".join(f">{folder}{i}_{name}\n{''.join(rng.choice(letters) for _ in range(200))}\n" for i in range(n)))
    train, test = str(tmp_path / "train"), str(tmp_path / "test")
    got = classify(spark, train, k=2, n_motifs=6, cv_folds=0, ml_method="rf", external_train=train, external_test=test, importance=False, min_cluster_length=100)
    assert got.split.mode == "fully_external" and got.split.test.count() == 12 and got.trained.accuracy > 0.7 and set(got.trained.motifs) <= set(got.selection.unique)
    one = classify(spark, train, k=2, n_motifs=6, cv_folds=0, ml_method="rf", min_size=100, external_test=str(tmp_path / "test" / "classA.fasta"), importance=False)
    assert one.split.mode == "external_test_only" and one.split.test.count() == 6
    with pytest.raises(ValueError):
        classify(spark, train, k=2, min_cluster_length=1000)


# ------------------------------------------------------------- queries without SQL, held against plain versions over the same tables

SMALL = "/root/testdata/sf0.001"


def plain_profiles(cluster_of, k):
    """cluster -> {kmer: norm} over documents as sequences, by counting in Python; a document may be in no cluster."""
    names = all_kmers("ACGT", k)
    raw = {}
    for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist():
        c = cluster_of(r)
        if c is not None:
            seq = "".join("ACGT"[(ord(x) - 97) % 4] for x in (r["text"] or "").lower() if "a" <= x <= "z")
            raw.setdefault(c, Counter()).update(w for i in range(len(seq) - k + 1) if len(w := seq[i : i + k]) == k)
    out = {}
    for c, counts in raw.items():
        v = [counts[n] for n in names]
        low, high = min(v), max(v)
        out[c] = {n: 0.5 if low == high else (x - low) / (high - low) for n, x in zip(names, v)}
    return names, out


def test_case3_query_equals_a_plain_one(spark):
    """Each class takes n div m of its own best unused motifs; the rest goes to the least homogeneous, here the first ones."""
    names, profiles = plain_profiles(lambda r: r["lang"] or "?", 4)
    used, picks = set(), {c: [] for c in sorted(profiles)}
    best = {c: sorted(names, key=lambda n: (-p[n], names.index(n))) for c, p in profiles.items()}
    rounds = [(c, 64 // len(profiles)) for c in sorted(profiles)] + [(c, 1) for c in sorted(profiles)[: 64 % len(profiles)]]
    for c, n in rounds:
        new = [x for x in best[c] if x not in used][:n]
        used.update(new)
        picks[c] += new
    want = {(c, i + 1, x) for c, v in picks.items() for i, x in enumerate(v)}
    assert {tuple(r) for r in catalog.QUERIES["select_motifs_case3"](spark, SMALL).collect()} == want


def test_case2_query_equals_a_plain_one(spark):
    """With fewer motifs than clusters (sources), classes take quotas by the sums over the clusters that they dominate."""
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    names, profiles = plain_profiles(lambda r: r["source"], 4)
    members = {}
    for r in rows:
        if r["source"] is not None:
            members.setdefault(r["source"], Counter())[r["lang"] or "?"] += 1
    dominant = {c: min(m, key=lambda x: (-m[x], x)) for c, m in members.items()}
    got = {tuple(r) for r in catalog.QUERIES["select_motifs_case2"](spark, SMALL).collect()}
    if 12 >= len(profiles):
        pytest.skip("as many clusters as motifs")
    classes, used, want = sorted(set(dominant.values())), set(), set()
    for i, c in enumerate(classes):
        score = {n: math.fsum(p[n] for s, p in profiles.items() if dominant[s] == c) for n in names}
        order = [x for x in sorted(names, key=lambda n: (-round(score[n], 9), names.index(n))) if x not in used]
        new = order[: 12 // len(classes) + (i < 12 % len(classes))]
        used.update(new)
        want |= {(c, k + 1, x) for k, x in enumerate(new)}
    assert got == want


@pytest.mark.parametrize("name", ["select_motifs_case2", "select_motifs_case3"])
def test_selection_sql_says_the_same(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = catalog.QUERIES[name](spark, SMALL).select("class", "pick_rank", "kmer").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(f"SELECT class, pick_rank, kmer FROM ({catalog.SQL[name]})").fetchall())


def plain_linkage(x):
    """Ward's merges by trying all pairs of clusters: (members, members) from first to last."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        def cost(a, b):
            gap = x[a].mean(0) - x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * (gap @ gap)

        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i], groups[j : j + 1] = groups[i] + groups[j], []
        yield frozenset(groups[i])


def test_linkage_query_equals_a_plain_one(spark):
    rows = sorted(pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], np.float64)
    tree = linkage.dendrogram(x[:60], [str(r["label"]) for r in rows[:60]])
    held, sets = {}, []
    for step, (a, b, _, size) in enumerate(tree.merges, 1):
        held[step] = (held[a] if a > 0 else {-a - 1}) | (held[b] if b > 0 else {-b - 1})
        sets.append(frozenset(held[step]))
        assert size == len(held[step])
    assert sets == list(plain_linkage(x[:60]))
    got = {r["seq_id"]: r["cluster"] for r in catalog.QUERIES["hclust_order"](spark, SMALL).collect()}
    full = linkage.dendrogram(x, [str(r["label"]) for r in rows])
    assert got == {rows[i]["vec_id"]: c for i, c in zip(full.order, segment.assignment(full.labels, 0.8, 3))}


def test_exemplar_query_groups_by_similarity(spark):
    """Each row's exemplar is of its class and stands for itself, and no other exemplar of the class, but for those that the last step moved, is nearer by much."""
    rows = {r["vec_id"]: r for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()}
    got = {r["id"]: r["exemplar"] for r in catalog.QUERIES["ap_exemplars"](spark, SMALL).collect()}
    assert set(got) == set(rows)
    for i, e in got.items():
        assert rows[i]["label"] == rows[e]["label"] and got[e] == e
    for e in set(got.values()):
        members = [i for i in got if got[i] == e]
        total = lambda c: sum(((np.array(rows[c]["embedding"]) - np.array(rows[i]["embedding"])) ** 2).sum() for i in members)
        assert total(e) <= min(map(total, members)) + 1e-9


def test_segment_query_keeps_its_promises(spark):
    """Every event is in one cluster of its user; clusters are runs of places; pure runs of three or more are whole."""
    held = {}
    for r in catalog.QUERIES["segment_clusters_full"](spark, SMALL).collect():
        held.setdefault(r["user_id"], []).append((r["place"], r["class"], r["cluster"]))
    assert sum(map(len, held.values())) == pq.read_table(f"{SMALL}/events.parquet").num_rows
    for rows in held.values():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(1, len(rows) + 1)) and all(c >= 1 for *_, c in rows)
        # numbered by first position
        order = list(dict.fromkeys(c for *_, c in rows))
        assert order == sorted(order)
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][1] == rows[i][1]:
                j += 1
            if j - i >= 3:
                assert len({c for *_, c in rows[i:j]}) == 1
            i = j
