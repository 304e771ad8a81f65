"""Registered queries over the driver tables, and the SQL that DuckDB holds them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import kmers as K
from strandlake.functions.sequences import LOWER, from_documents, header_class
from strandlake.operators import analysis, clusters, distance, graph, metrics, motifs, search, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(K.spread(table(spark, sf_dir, "documents")))


def ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in which the letter z became N, which no alphabet holds."""
    docs = K.spread(table(spark, sf_dir, "documents"))
    target = ("ACGT" * 7)[:25] + "N"
    seq = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LOWER, target)
    return docs.select(F.col("doc_id").alias("seq_id"), F.coalesce("lang", F.lit("?")).alias("class"), seq.alias("seq"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as rows of clusters: the source is the cluster, the language the class."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("cluster"), F.coalesce("lang", F.lit("?")).alias("class"), F.col("n_chars").alias("length"))


def lang_profiles(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Profiles with a cluster for each pair of language and source, and what its class is."""
    seqs = sequences(spark, sf_dir)
    return motifs.cluster_profiles(seqs.withColumn("cluster", F.col("class")), k, by="cluster")


def own_class(profiles: DataFrame) -> DataFrame:
    """Clusters of one class each, named like it."""
    return profiles.select("cluster").distinct().select(F.col("cluster").alias("cluster_id"), F.col("cluster").alias("dominant_class"), F.lit(1.0).alias("homogeneity"))


_TARGET = ("ACGT" * 7)[:26]
_SEQS = f"seqs AS (SELECT doc_id AS seq_id, coalesce(lang, '?') AS class, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LOWER}', '{_TARGET}') AS seq FROM documents)"


def _vocab(k: int, name: str = "vocab") -> str:
    """All k-mers over ACGT with their number."""
    letters = "(VALUES (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T'))"
    joins = " CROSS JOIN ".join(f"{letters} AS l{i}(o, c)" for i in range(k))
    ord_ = " + ".join(f"l{i}.o * {4 ** (k - 1 - i)}" for i in range(k))
    return f"{name} AS (SELECT ({ord_})::BIGINT AS ord, {' || '.join(f'l{i}.c' for i in range(k))} AS kmer FROM {joins})"


def _windows(k: int) -> str:
    """Class counts of all windows."""
    return f"w AS (SELECT seq_id, class, substr(seq, i::BIGINT, {k}) AS kmer FROM (SELECT seq_id, class, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs)), kc AS (SELECT class, kmer, count(*) AS n FROM w GROUP BY ALL)"


def _profiles(k: int) -> str:
    return f"""{_SEQS}, {_windows(k)}, {_vocab(k)},
raw AS (SELECT c.class AS cluster, v.ord, v.kmer, coalesce(kc.n, 0)::BIGINT AS raw FROM (SELECT DISTINCT class FROM kc) c CROSS JOIN vocab v LEFT JOIN kc ON kc.class = c.class AND kc.kmer = v.kmer),
prof AS (SELECT *, CASE WHEN max(raw) OVER p = min(raw) OVER p THEN 0.5 ELSE (raw - min(raw) OVER p)::DOUBLE / (max(raw) OVER p - min(raw) OVER p) END AS norm FROM raw WINDOW p AS (PARTITION BY cluster))"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- k-mers


@query("kmer_vocabulary", f"WITH {_vocab(6)} SELECT ord, kmer FROM vocab")
def kmer_vocabulary(spark, sf_dir):
    return K.vocabulary(spark, k=6)


@query("kmer_counts_by_seq", f"WITH {_SEQS}, {_windows(3)} SELECT seq_id, class, kmer, count(*) AS n FROM w GROUP BY ALL")
def kmer_counts_by_seq(spark, sf_dir):
    return K.count_by_sequence(sequences(spark, sf_dir), 3).select("seq_id", "class", "kmer", "n")


@query("kmer_counts_by_class", f"WITH {_SEQS}, {_windows(4)} SELECT class, kmer, n FROM kc")
def kmer_counts_by_class(spark, sf_dir):
    return K.count_by_class(sequences(spark, sf_dir), 4).select("class", "kmer", "n")


@query("kmer_zero_filled", f"WITH {_profiles(5)} SELECT cluster AS class, ord, kmer, raw AS n FROM raw")
def kmer_zero_filled(spark, sf_dir):
    return K.zero_fill(K.count_by_class(sequences(spark, sf_dir), 5), "class", k=5)


_AMBIGUOUS = _SEQS.replace(_TARGET, _TARGET[:25] + "N")


@query("kmer_ambiguous_windows", f"WITH {_AMBIGUOUS}, {_windows(3)} SELECT class, kmer, n FROM kc WHERE kmer NOT LIKE '%N%'")
def kmer_ambiguous_windows(spark, sf_dir):
    return K.count_by_class(ambiguous(spark, sf_dir), 3).select("class", "kmer", "n")


@query(
    "kmer_strict_validation",
    f"""WITH {_AMBIGUOUS} SELECT class, count(*) AS n, count(*) FILTER (WHERE length(seq) = 0) AS n_empty, count(*) FILTER (WHERE length(seq) < 6) AS n_short,
count(*) FILTER (WHERE regexp_matches(seq, '[^ACGT]')) AS n_odd_letters, count(*) FILTER (WHERE length(seq) >= 6 AND NOT regexp_matches(seq, '[^ACGT]')) AS n_valid FROM seqs GROUP BY class""",
)
def kmer_strict_validation(spark, sf_dir):
    seqs = ambiguous(spark, sf_dir)
    odd, size = F.col("seq").rlike("[^ACGT]"), F.length("seq")
    return seqs.groupBy("class").agg(F.count("*").alias("n"), F.count_if(size == 0).alias("n_empty"), F.count_if(size < 6).alias("n_short"), F.count_if(odd).alias("n_odd_letters"), F.count_if((size >= 6) & ~odd).alias("n_valid"))


@query(
    "kmer_summary_stats",
    f"""WITH {_profiles(4)} SELECT cluster AS class, sum(raw)::BIGINT AS total_kmers, count(*) AS possible_kmers, count(*) FILTER (WHERE raw > 0) AS observed_kmers, count(*) FILTER (WHERE raw = 0) AS zero_kmers,
min(raw) AS min_count, max(raw) AS max_count, round(avg(raw), 2) AS mean_count, median(raw)::DOUBLE AS median_count FROM raw GROUP BY cluster""",
)
def kmer_summary_stats(spark, sf_dir):
    full = K.zero_fill(K.count_by_class(sequences(spark, sf_dir), 4), "class", k=4)
    return full.groupBy("class").agg(
        F.sum("n").alias("total_kmers"), F.count("*").alias("possible_kmers"), F.count_if(F.col("n") > 0).alias("observed_kmers"), F.count_if(F.col("n") == 0).alias("zero_kmers"),
        F.min("n").alias("min_count"), F.max("n").alias("max_count"), F.round(F.avg("n"), 2).alias("mean_count"), F.median("n").alias("median_count"),
    )


_TOTALS = f"WITH {_SEQS}, {_windows(4)}, t AS (SELECT kmer, sum(n)::BIGINT AS n FROM kc GROUP BY kmer)"


def _totals(spark, sf_dir) -> DataFrame:
    return K.count_by_class(sequences(spark, sf_dir), 4).groupBy("ord", "kmer").agg(F.sum("n").alias("n"))


@query("kmer_top10", f"{_TOTALS} SELECT kmer, n FROM t ORDER BY n DESC, kmer LIMIT 10")
def kmer_top10(spark, sf_dir):
    return _totals(spark, sf_dir).orderBy(F.desc("n"), "ord").limit(10).select("kmer", "n")


@query("kmer_subset_regex", f"{_TOTALS} SELECT kmer, n FROM t WHERE regexp_matches(kmer, '^A.*T$')")
def kmer_subset_regex(spark, sf_dir):
    return _totals(spark, sf_dir).where(F.col("kmer").rlike("^A.*T$")).select("kmer", "n")


@query("kmer_sort", f"{_TOTALS} SELECT kmer, n, row_number() OVER (ORDER BY n DESC, kmer) AS place FROM t")
def kmer_sort(spark, sf_dir):
    return _totals(spark, sf_dir).select("kmer", "n", F.row_number().over(Window.orderBy(F.desc("n"), "ord")).cast("long").alias("place"))


@query("dataset_overview", f"WITH {_SEQS} SELECT count(*) AS n_sequences, count(DISTINCT class) AS n_classes, min(length(seq))::BIGINT AS min_length, round(avg(length(seq)), 4) AS mean_length, max(length(seq))::BIGINT AS max_length, sum(length(seq))::BIGINT AS letters FROM seqs")
def dataset_overview(spark, sf_dir):
    size = F.col("length").cast("long")
    return sequences(spark, sf_dir).agg(F.count("*").alias("n_sequences"), F.count_distinct("class").alias("n_classes"), F.min(size).alias("min_length"), F.round(F.avg(size), 4).alias("mean_length"), F.max(size).alias("max_length"), F.sum(size).alias("letters"))


@query("class_distribution", "SELECT coalesce(lang, '?') AS class, count(*) AS n FROM documents GROUP BY 1")
def class_distribution(spark, sf_dir):
    return clusters.class_sizes(labelled(spark, sf_dir))


@query("header_class", r"SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\..*', '') AS class, count(*) AS n FROM pages GROUP BY 1")
def header_class_query(spark, sf_dir):
    name = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").groupBy(header_class(name).alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- word graph

_EDGES = f"{_SEQS}, e AS (SELECT seq_id, substr(seq, i::BIGINT, 3) AS src, substr(seq, i::BIGINT + 3, 3) AS dst FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4, 1)) AS i FROM seqs WHERE length(seq) >= 6))"


@query("word_graph_edges", f"WITH {_EDGES} SELECT seq_id, src, dst, count(*) AS n FROM e GROUP BY ALL")
def word_graph_edges(spark, sf_dir):
    # a seq_id may occur in several rows
    return graph.word_edges(sequences(spark, sf_dir), 3).groupBy("seq_id", "src", "dst").agg(F.sum("n").alias("n"))


@query("word_graph_adjacency", f"WITH {_EDGES} SELECT src, dst, count(*) AS n FROM e GROUP BY ALL")
def word_graph_adjacency(spark, sf_dir):
    return graph.adjacency(sequences(spark, sf_dir), 3)


@query(
    "word_graph_missing_vertices",
    f"WITH {_SEQS}, {_vocab(6)}, e AS (SELECT substr(seq, i::BIGINT, 6) AS src, substr(seq, i::BIGINT + 6, 6) AS dst FROM (SELECT seq, unnest(range(1, length(seq) - 10, 1)) AS i FROM seqs WHERE length(seq) >= 12)) SELECT kmer FROM vocab WHERE kmer NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
)
def word_graph_missing_vertices(spark, sf_dir):
    """The 6-mers that no window of any document holds."""
    return graph.missing_vertices(graph.adjacency(sequences(spark, sf_dir), 6), K.vocabulary(spark, k=6))


# ---------------------------------------------------------------- splits


@query("length_filter_class_sizes", "SELECT coalesce(lang, '?') AS class, count(*) AS n FROM documents WHERE n_chars >= 800 GROUP BY 1")
def length_filter_class_sizes(spark, sf_dir):
    return clusters.class_sizes(split.long_enough(labelled(spark, sf_dir), 800))


@query(
    "train_quota_per_class",
    """WITH s AS (SELECT coalesce(lang, '?') AS class, count(*) AS size FROM documents WHERE n_chars >= 800 GROUP BY 1)
SELECT class, size, least(size, 100)::BIGINT AS n_cap, CASE WHEN size >= 100 THEN 100 ELSE greatest(1, floor(size * 0.7::DOUBLE)) END::BIGINT AS n_prop FROM s""",
)
def train_quota_per_class(spark, sf_dir):
    rows = split.long_enough(labelled(spark, sf_dir), 800)
    cap = split.quotas(rows, 100, rule="cap").withColumnRenamed("n_train", "n_cap")
    return cap.join(split.quotas(rows, 100, rule="prop").select("class", F.col("n_train").alias("n_prop")), "class")


_PICK = """r AS (SELECT doc_id AS seq_id, coalesce(lang, '?') AS class, n_chars AS length, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) AS k FROM documents WHERE n_chars >= 800), train AS (SELECT * FROM r WHERE k <= 60)"""


def _train(spark, sf_dir) -> DataFrame:
    return split.pick(split.long_enough(labelled(spark, sf_dir), 800), 60, seed=None)


@query("train_pick_deterministic", f"WITH {_PICK} SELECT seq_id, class, length FROM train")
def train_pick_deterministic(spark, sf_dir):
    return _train(spark, sf_dir).select("seq_id", "class", "length")


@query("test_remainder", f"WITH {_PICK} SELECT doc_id AS seq_id, coalesce(lang, '?') AS class FROM documents WHERE doc_id NOT IN (SELECT seq_id FROM train)")
def test_remainder(spark, sf_dir):
    return split.rest(labelled(spark, sf_dir), _train(spark, sf_dir)).select("seq_id", "class")


@query("leakage_check", f"WITH {_PICK} SELECT count(*) AS n_leaked FROM train WHERE seq_id IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT seq_id FROM train))")
def leakage_check(spark, sf_dir):
    train = _train(spark, sf_dir)
    return split.leaked(train, split.rest(labelled(spark, sf_dir), train)).agg(F.count("*").alias("n_leaked"))


_CONV = f"cseq AS (SELECT translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LOWER}', '{_TARGET}') AS seq FROM conversations), cw AS (SELECT DISTINCT substr(seq, i::BIGINT, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM cseq))"


@query("kmer_alignment_common", f"WITH {_SEQS}, {_windows(6)}, {_CONV} SELECT DISTINCT kmer FROM kc WHERE kmer IN (SELECT kmer FROM cw)")
def kmer_alignment_common(spark, sf_dir):
    chat = K.spread(table(spark, sf_dir, "conversations")).select(F.lit("chat").alias("class"), F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LOWER, _TARGET).alias("seq"))
    return split.common_kmers(K.count_by_class(sequences(spark, sf_dir), 6), K.count_by_class(chat, 6))


@query(
    "stratified_partition",
    """WITH r AS (SELECT doc_id AS seq_id, coalesce(lang, '?') AS class, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY coalesce(lang, '?')) AS size FROM documents)
SELECT seq_id, class, CASE WHEN k <= ceil(size * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS dataset FROM r""",
)
def stratified_partition(spark, sf_dir):
    return split.stratified(labelled(spark, sf_dir).select("seq_id", "class"), 0.7)


# ---------------------------------------------------------------- distances


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class"), F.col("embedding").cast("array<double>").alias("x"))


_CENTROID = """cent AS (SELECT label, pos, avg(v) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
cd AS (SELECT e.vec_id AS id, e.label::VARCHAR AS class, sqrt(sum((e.v - c.c) * (e.v - c.c))) AS d FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) e JOIN cent c USING (label, pos) GROUP BY ALL)"""


@query("centroid_distance", f"WITH {_CENTROID} SELECT id, class, round(d, 6) AS d FROM cd")
def centroid_distance(spark, sf_dir):
    return distance.centroid_distance(vectors(spark, sf_dir)).select("id", "class", F.round("d", 6).alias("d"))


@query(
    "near_far_sample",
    f"""WITH {_CENTROID}, s AS (SELECT class, count(*) AS size FROM cd GROUP BY 1), b AS (SELECT CASE WHEN min(size) * count(*) > 300 THEN floor(300 / count(*)) ELSE min(size) END::BIGINT AS n FROM s),
r AS (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY round(d, 9), id) AS k, size, n, round(0.7::DOUBLE * n)::BIGINT AS far FROM cd JOIN s USING (class), b)
SELECT * FROM (SELECT id, class, CASE WHEN size <= n THEN 'all' WHEN k <= n - far THEN 'near' WHEN k > size - far THEN 'far' END AS pick FROM r) WHERE pick IS NOT NULL""",
)
def near_far_sample(spark, sf_dir):
    d = distance.centroid_distance(vectors(spark, sf_dir)).withColumn("d", F.round("d", 9))
    return distance.near_far_sample(d, limit=300)


_PAIR = "SELECT a.vec_id AS i, b.vec_id AS j, round({}, 4) AS {} FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) b ON a.vec_id < b.vec_id"
_GAPS = "[abs(p[1] - p[2]) FOR p IN list_zip(a.x, b.x)]"


@query("pairwise_euclidean", _PAIR.format("list_distance(a.x, b.x)", "d"))
def pairwise_euclidean(spark, sf_dir):
    return distance.pairwise(vectors(spark, sf_dir)).select("i", "j", F.round("d", 4).alias("d"))


@query("pairwise_manhattan", _PAIR.format(f"list_sum({_GAPS})", "d"))
def pairwise_manhattan(spark, sf_dir):
    return distance.pairwise(vectors(spark, sf_dir), "manhattan", digits=4)


@query("pairwise_maximum", _PAIR.format(f"list_max({_GAPS})", "d"))
def pairwise_maximum(spark, sf_dir):
    return distance.pairwise(vectors(spark, sf_dir), "maximum").select("i", "j", F.round("d", 4).alias("d"))


@query("neg_sq_similarity", _PAIR.format("-list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a.x, b.x)])", "s"))
def neg_sq_similarity(spark, sf_dir):
    return distance.similarity(vectors(spark, sf_dir)).select("i", "j", F.round("s", 4).alias("s"))


_HEADS = "heads AS (SELECT label, min(vec_id) AS exemplar FROM embeddings GROUP BY label)"


@query(
    "nearest_exemplar",
    f"""WITH {_HEADS}, h AS (SELECT e.vec_id AS exemplar, e.embedding::DOUBLE[] AS y FROM embeddings e JOIN heads ON e.vec_id = heads.exemplar),
d AS (SELECT e.vec_id AS id, h.exemplar, list_distance(e.embedding::DOUBLE[], h.y) AS d FROM embeddings e CROSS JOIN h)
SELECT id, arg_min(exemplar, (d, exemplar)) AS exemplar, round(min(d), 6) AS d FROM d GROUP BY id""",
)
def nearest_exemplar(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    heads = rows.groupBy("class").agg(F.min_by("x", "id").alias("x"), F.min("id").alias("id"))
    points = [(r["id"], r["x"]) for r in heads.select("id", "x").collect()]  # one for each of the ten labels
    return distance.nearest_exemplar(rows, points).select("id", "exemplar", F.round("d", 6).alias("d"))


# ---------------------------------------------------------------- segments and clusters

_EVENTS = "ev AS (SELECT user_id, event_type AS class, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)"


def event_runs(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("class"), F.row_number().over(order).cast("long").alias("place"))


@query(
    "contiguous_segments",
    f"""WITH {_EVENTS}, r AS (SELECT user_id, class, place, place - row_number() OVER (PARTITION BY user_id, class ORDER BY place) AS island FROM ev)
SELECT user_id, class, min(place) AS segment_start, max(place) AS segment_end, count(*) AS n FROM r GROUP BY user_id, class, island""",
)
def contiguous_segments(spark, sf_dir):
    return clusters.segments(event_runs(spark, sf_dir), ["user_id", "class"], "place")


@query(
    "pure_run_clusters",
    f"""WITH {_EVENTS}, r AS (SELECT user_id, class, place, place - row_number() OVER (PARTITION BY user_id, class ORDER BY place) AS island FROM ev)
SELECT user_id, class, min(place) AS run_start, max(place) AS run_end, count(*) AS n FROM r GROUP BY user_id, class, island HAVING count(*) >= 2""",
)
def pure_run_clusters(spark, sf_dir):
    return clusters.pure_runs(event_runs(spark, sf_dir), "place", min_size=2, by=["user_id"])


_MEMBERS = "m AS (SELECT source AS cluster, coalesce(lang, '?') AS class, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2), tot AS (SELECT coalesce(lang, '?') AS class, count(*) AS total FROM documents GROUP BY 1)"


@query("cluster_homogeneity", f"WITH {_MEMBERS} SELECT cluster, round(max(n)::DOUBLE / sum(n), 9) AS homogeneity FROM m GROUP BY cluster")
def cluster_homogeneity(spark, sf_dir):
    return clusters.homogeneity(labelled(spark, sf_dir)).select("cluster", F.round("homogeneity", 9).alias("homogeneity"))


@query("dominant_class", f"WITH {_MEMBERS} SELECT cluster, arg_min(class, (-n, class)) AS dominant_class FROM m GROUP BY cluster")
def dominant_class(spark, sf_dir):
    return clusters.dominant_class(labelled(spark, sf_dir))


@query("complete_class_any", f"WITH {_MEMBERS} SELECT cluster, bool_or(n = total) AS is_complete FROM m JOIN tot USING (class) GROUP BY cluster")
def complete_class_any(spark, sf_dir):
    return clusters.complete_any(labelled(spark, sf_dir))


@query("cluster_composition", f"WITH {_MEMBERS} SELECT cluster, string_agg(class || ':' || n, '; ' ORDER BY class) AS class_composition FROM m GROUP BY cluster")
def cluster_composition(spark, sf_dir):
    return clusters.composition(labelled(spark, sf_dir))


@query(
    "cluster_summary",
    f"""WITH {_MEMBERS} SELECT cluster AS cluster_id, sum(n)::BIGINT AS n_elements, arg_min(class, (-n, class)) AS dominant_class, round(max(n)::DOUBLE / sum(n), 9) AS homogeneity, count(*) AS n_classes,
string_agg(class || ':' || n, '; ' ORDER BY class) AS class_composition, arg_min(n = total, (-n, class)) AS is_complete_class FROM m JOIN tot USING (class) GROUP BY cluster""",
)
def cluster_summary(spark, sf_dir):
    return clusters.summary(labelled(spark, sf_dir)).withColumn("homogeneity", F.round("homogeneity", 9))


@query("observed_minimum", f"WITH {_MEMBERS}, p AS (SELECT round(max(n)::DOUBLE / sum(n), 9) AS h, sum(n)::BIGINT AS n FROM m GROUP BY cluster) SELECT min(h) AS min_homogeneity, min(n) AS min_size FROM p")
def observed_minimum(spark, sf_dir):
    return clusters.observed_minimum(labelled(spark, sf_dir)).select(F.round("min_homogeneity", 9).alias("min_homogeneity"), "min_size")


# ---------------------------------------------------------------- motifs


@query("cluster_motifs_raw", f"WITH {_profiles(4)} SELECT cluster, kmer, raw FROM raw")
def cluster_motifs_raw(spark, sf_dir):
    return lang_profiles(spark, sf_dir, 4).select("cluster", "kmer", "raw")


@query("cluster_motifs_norm", f"WITH {_profiles(4)} SELECT cluster, kmer, round(norm, 12) AS norm FROM prof")
def cluster_motifs_norm(spark, sf_dir):
    return lang_profiles(spark, sf_dir, 4).select("cluster", "kmer", F.round("norm", 12).alias("norm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many languages hold each 3-mer above their rarest one, with the languages' mean normalised frequency."""
    profiles = lang_profiles(spark, sf_dir, 3)
    return profiles.groupBy("ord", "kmer").agg(F.count_if(F.col("norm") > 0).alias("n_clusters"), F.round(F.avg("norm"), 9).alias("mean_norm"))


QUERIES["kmer_presence_profile"] = flagship
SQL["kmer_presence_profile"] = f"WITH {_profiles(3)} SELECT ord, kmer, count(*) FILTER (WHERE norm > 0) AS n_clusters, round(avg(norm), 9) AS mean_norm FROM prof GROUP BY ALL"


@query("motif_scores_by_class", f"WITH {_profiles(4)} SELECT CASE WHEN cluster IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS class, kmer, round(sum(norm), 9) AS score FROM prof GROUP BY ALL")
def motif_scores_by_class(spark, sf_dir):
    profiles = lang_profiles(spark, sf_dir, 4)
    family = F.when(F.col("cluster_id").isin("en", "de"), "germanic").otherwise("romance")
    return motifs.class_scores(profiles, own_class(profiles).withColumn("dominant_class", family)).select("class", "kmer", F.round("score", 9).alias("score"))


@query("motif_rank_by_cluster", f"WITH {_profiles(4)} SELECT * FROM (SELECT cluster, kmer, row_number() OVER (PARTITION BY cluster ORDER BY norm DESC, ord) AS rank FROM prof) WHERE rank <= 32")
def motif_rank_by_cluster(spark, sf_dir):
    return motifs.ranked(lang_profiles(spark, sf_dir, 4), "cluster", "norm", 32).select("cluster", "kmer", F.col("rank").cast("long").alias("rank"))


@query(
    "motif_quota",
    "WITH c AS (SELECT DISTINCT coalesce(lang, '?') AS class FROM documents), r AS (SELECT class, row_number() OVER (ORDER BY class) AS k, count(*) OVER () AS c FROM c) SELECT class, (250 // c + CASE WHEN k <= 250 % c THEN 1 ELSE 0 END)::BIGINT AS quota FROM r",
)
def motif_quota(spark, sf_dir):
    names = labelled(spark, sf_dir).select("class").distinct()
    order, size = Window.orderBy("class"), F.count("*").over(Window.partitionBy())
    return names.select("class", F.row_number().over(order).alias("k"), size.alias("c")).selectExpr("class", "CAST(250 DIV c + CASE WHEN k <= 250 % c THEN 1 ELSE 0 END AS BIGINT) AS quota")


_LABEL = "lab AS (SELECT DISTINCT cluster, cluster AS class FROM prof)"


@query("unique_cluster_motifs", f"WITH {_profiles(5)} SELECT min(ord) AS ord, kmer AS motif, min(cluster) AS cluster, min(cluster) AS class, round(min(norm), 12) AS value FROM prof WHERE norm > 0 GROUP BY kmer HAVING count(*) = 1")
def unique_cluster_motifs(spark, sf_dir):
    profiles = lang_profiles(spark, sf_dir, 5)
    return analysis.unique_cluster_motifs(profiles, own_class(profiles)).withColumn("value", F.round("value", 12))


@query("cluster_frequency_ranking", f"WITH {_profiles(4)}, c AS (SELECT ord, kmer, count(*) FILTER (WHERE norm > 0) AS n_clusters FROM prof GROUP BY ALL) SELECT ord, kmer, n_clusters, row_number() OVER (ORDER BY n_clusters DESC, ord) AS rank FROM c")
def cluster_frequency_ranking(spark, sf_dir):
    return analysis.cluster_frequency(lang_profiles(spark, sf_dir, 4)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "class_frequency_matrix",
    f"""WITH {_profiles(5)} SELECT ord, kmer, count(*) FILTER (WHERE norm > 0 AND cluster = 'de') AS de, count(*) FILTER (WHERE norm > 0 AND cluster = 'en') AS en, count(*) FILTER (WHERE norm > 0 AND cluster = 'es') AS es,
count(*) FILTER (WHERE norm > 0 AND cluster = 'fr') AS fr, count(*) FILTER (WHERE norm > 0 AND cluster IN ('de', 'en', 'es', 'fr')) AS "Total" FROM prof GROUP BY ALL""",
)
def class_frequency_matrix(spark, sf_dir):
    profiles = lang_profiles(spark, sf_dir, 5)
    return analysis.class_frequency_matrix(profiles, own_class(profiles), ["de", "en", "es", "fr"])


_FAMILY = "CASE WHEN cluster IN ('en', 'de') THEN 'germanic' ELSE 'romance' END"


@query(
    "unique_class_motifs",
    f"""WITH {_profiles(5)}, lab AS (SELECT DISTINCT cluster, {_FAMILY} AS class FROM prof), t AS (SELECT class, count(*) AS total_class_clusters FROM lab GROUP BY 1),
p AS (SELECT ord, kmer, min(class) AS class, count(*) AS n_clusters_with_motif FROM prof JOIN lab USING (cluster) WHERE norm > 0 GROUP BY ord, kmer HAVING count(DISTINCT class) = 1)
SELECT ord, kmer AS motif, class, n_clusters_with_motif, total_class_clusters FROM p JOIN t USING (class)""",
)
def unique_class_motifs(spark, sf_dir):
    profiles = lang_profiles(spark, sf_dir, 5)
    family = F.when(F.col("cluster_id").isin("en", "de"), "germanic").otherwise("romance")
    return analysis.unique_class_motifs(profiles, own_class(profiles).withColumn("dominant_class", family))


@query(
    "motifs_by_class_rank",
    f"""WITH {_SEQS}, {_windows(3)}, s AS (SELECT class, kmer, count(*) AS total, count(DISTINCT seq_id) AS carriers FROM w GROUP BY ALL),
g AS (SELECT kmer, class FROM (SELECT DISTINCT kmer FROM w) CROSS JOIN (SELECT DISTINCT class FROM w)),
f AS (SELECT kmer, class, coalesce(total, 0) AS total, coalesce(carriers, 0) AS carriers FROM g LEFT JOIN s USING (kmer, class)), x AS (SELECT length(max(total)::VARCHAR) AS width FROM f)
SELECT kmer, class, lpad(total::VARCHAR, width::INT, '0') || '|' || carriers AS shown, round(sum(total) OVER (PARTITION BY kmer)::DOUBLE / count(*) OVER (PARTITION BY kmer), 2) AS mean FROM f, x""",
)
def motifs_by_class_rank(spark, sf_dir):
    return analysis.motif_rank(K.count_by_sequence(sequences(spark, sf_dir), 3)).select("kmer", "class", "shown", "mean")


@query("test_unique_class_motifs", f"WITH {_SEQS}, {_windows(6)} SELECT kmer AS motif, min(class) AS class, sum(n)::BIGINT AS total FROM kc GROUP BY kmer HAVING count(*) = 1")
def test_unique_class_motifs(spark, sf_dir):
    return analysis.test_unique_class_motifs(K.count_by_class(sequences(spark, sf_dir), 6)).select("motif", "class", "total")


@query("test_class_frequency", f"WITH {_SEQS}, {_windows(6)} SELECT kmer, count(*) AS n_classes FROM kc GROUP BY kmer")
def test_class_frequency(spark, sf_dir):
    return analysis.test_class_frequency(K.count_by_class(sequences(spark, sf_dir), 6)).select("kmer", "n_classes")


# ---------------------------------------------------------------- motif search

_MOTIFS = ("ACGTAC", "AAAA", "GATTACA", "CATG")
_HITS = f"""hits AS (SELECT m AS motif, seq_id, class, length(seq) AS len, string_split(seq, m) AS parts FROM (SELECT *, unnest({list(_MOTIFS)}) AS m FROM seqs)),
pos AS (SELECT motif, seq_id, class, len, generate_subscripts(parts, 1) AS i, length(unnest(parts)) AS l, len(parts) AS np FROM hits WHERE len(parts) > 1),
occ AS (SELECT motif, 'doc_' || seq_id AS sequence_name, class, i, np, len, (sum(l) OVER (PARTITION BY motif, seq_id ORDER BY i) + (i - 1) * length(motif) + 1)::INT AS position_start FROM pos)"""


@query("motif_occurrences", f"WITH {_SEQS}, {_HITS} SELECT motif, sequence_name, class, position_start, position_start + length(motif)::INT - 1 AS position_end, len::INT AS sequence_length FROM occ WHERE i < np")
def motif_occurrences(spark, sf_dir):
    return search.find_motifs(sequences(spark, sf_dir), list(_MOTIFS))


@query("occurrences_by_dataset", f"WITH {_SEQS}, {_HITS} SELECT CASE WHEN class = 'en' THEN 'train' ELSE 'validation' END AS dataset, motif, count(*) AS n FROM occ WHERE i < np GROUP BY ALL")
def occurrences_by_dataset(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    found = search.kmers_in_seq(seqs.where("class = 'en'"), list(_MOTIFS), validation=seqs.where("class <> 'en'"))
    return search.occurrences_by_dataset(found)


# ---------------------------------------------------------------- metrics

_CONFUSION = "cf AS (SELECT quality::VARCHAR AS predicted, toxic::VARCHAR AS actual, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL)"


def predictions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("predicted"), F.col("toxic").cast("string").alias("actual"))


@query("confusion_matrix", f"WITH {_CONFUSION} SELECT * FROM cf")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query(
    "accuracy_kappa",
    f"""WITH {_CONFUSION}, t AS (SELECT sum(n)::BIGINT AS total, sum(CASE WHEN predicted = actual THEN n ELSE 0 END)::BIGINT AS correct FROM cf),
c AS (SELECT sum(p * a)::DOUBLE AS chance FROM (SELECT predicted AS level, sum(n) AS p FROM cf GROUP BY 1) JOIN (SELECT actual AS level, sum(n) AS a FROM cf GROUP BY 1) USING (level))
SELECT total, correct, round(correct / total, 9) AS accuracy, round((correct / total - chance / (total * total)) / (1 - chance / (total * total)), 9) AS kappa FROM t, c""",
)
def accuracy_kappa(spark, sf_dir):
    out = metrics.accuracy_kappa(metrics.confusion(predictions(spark, sf_dir)))
    return out.select("total", "correct", F.round("accuracy", 9).alias("accuracy"), F.round("kappa", 9).alias("kappa"))


@query(
    "model_comparison",
    "WITH m AS (SELECT 'rf' AS model, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labels UNION ALL SELECT 'xgb', round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 9) FROM labels) SELECT model, accuracy, row_number() OVER (ORDER BY accuracy DESC, model DESC) AS rank FROM m",
)
def model_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    rate = lambda name, hit: rows.agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 9).alias("accuracy")).select(F.lit(name).alias("model"), "accuracy")
    both = rate("rf", F.col("quality") == 1).unionByName(rate("xgb", F.col("toxic") == 0))
    return metrics.best_model(both).withColumn("rank", F.col("rank").cast("long"))


@query(
    "cv_best_round",
    """WITH e AS (SELECT l_linenumber AS round, l_orderkey % 10 AS fold, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS error FROM lineitem GROUP BY 1, 2),
p AS (SELECT round, avg(error) AS m, stddev_pop(error) AS s, count(*) AS folds FROM e GROUP BY 1)
SELECT round AS best_round, round(1 - m, 9) AS accuracy, round(s, 9) AS sd, folds FROM p ORDER BY round(m, 12), round LIMIT 1""",
)
def cv_best_round(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    errors = rows.groupBy(F.col("l_linenumber").alias("round"), (F.col("l_orderkey") % 10).alias("fold")).agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("error"))
    return metrics.best_round(errors).select("best_round", F.round("accuracy", 9).alias("accuracy"), F.round("sd", 9).alias("sd"), "folds")


# ---------------------------------------------------------------- selection without replacement

# turns (t, class, ks, q): in turn t, class takes the first q of ks that no turn before took
_TURNS = """taken AS (SELECT 0::BIGINT AS t, ''::VARCHAR AS class, []::VARCHAR[] AS used, []::VARCHAR[] AS got UNION ALL
SELECT t, class, list_concat(used, got), got FROM (SELECT u.t, u.class, p.used, list_filter(u.ks, lambda x: NOT list_contains(p.used, x))[1:u.q] AS got FROM taken p JOIN turns u ON u.t = p.t + 1)),
picked AS (SELECT t, class, generate_subscripts(got, 1) AS i, unnest(got) AS kmer FROM taken)
SELECT class, row_number() OVER (PARTITION BY class ORDER BY t, i)::INT AS pick_rank, kmer FROM picked"""


def _rows(spark, chosen: motifs.Selection) -> DataFrame:
    return spark.createDataFrame(chosen.rows(), "class string, pick_rank int, kmer string")


@query(
    "select_motifs_case2",
    f"""WITH RECURSIVE {_profiles(4).replace(_SEQS, _SEQS.replace("coalesce(lang, '?') AS class", "source AS class").replace("FROM documents", "FROM documents WHERE source IS NOT NULL"))}, {_MEMBERS},
dom AS (SELECT cluster, arg_min(class, (-n, class)) AS class FROM m GROUP BY cluster),
score AS (SELECT class, ord, kmer, sum(norm) AS score FROM prof JOIN dom USING (cluster) GROUP BY ALL),
rk AS (SELECT class, kmer, row_number() OVER (PARTITION BY class ORDER BY round(score, 9) DESC, ord) AS rank FROM score QUALIFY rank <= 12),
lists AS (SELECT class, list(kmer ORDER BY rank) AS ks, row_number() OVER (ORDER BY class) AS i, count(*) OVER () AS c FROM rk GROUP BY class),
turns AS (SELECT i AS t, class, ks, 12 // c + CASE WHEN i <= 12 % c THEN 1 ELSE 0 END AS q FROM lists),
{_TURNS}""",
)
def select_motifs_case2(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    profiles = motifs.cluster_profiles(seqs.join(labelled(spark, sf_dir).select("seq_id", "cluster"), "seq_id"), 4).cache()
    return _rows(spark, motifs.select_motifs(profiles, clusters.summary(labelled(spark, sf_dir)), 12, n_classes=4))


@query(
    "select_motifs_case3",
    f"""WITH RECURSIVE {_profiles(4)},
rk AS (SELECT cluster AS class, kmer, row_number() OVER (PARTITION BY cluster ORDER BY norm DESC, ord) AS rank FROM prof QUALIFY rank <= 64),
lists AS (SELECT class, list(kmer ORDER BY rank) AS ks, row_number() OVER (ORDER BY class) AS i, count(*) OVER () AS m FROM rk GROUP BY class),
turns AS (SELECT i AS t, class, ks, 64 // m AS q FROM lists UNION ALL SELECT m + i, class, ks, 1 FROM lists WHERE i <= 64 % m),
{_TURNS}""",
)
def select_motifs_case3(spark, sf_dir):
    profiles = lang_profiles(spark, sf_dir, 4).cache()
    return _rows(spark, motifs.select_motifs(profiles, own_class(profiles), 64))


# ---------------------------------------------------------------- sequential and learned stages (no SQL form; tested against plain versions)


@query("segment_clusters_full")
def segment_clusters_full(spark, sf_dir):
    """The full segmentation of each user's ordered events, one user a group."""
    from strandlake.operators.segment import assignment

    def run(group):
        group = group.sort_values("place")
        return group.assign(cluster=assignment(group["class"].tolist(), 0.7, 3))[["user_id", "place", "class", "cluster"]]

    return event_runs(spark, sf_dir).groupBy("user_id").applyInPandas(run, "user_id long, place long, class string, cluster int")


@query("hclust_order")
def hclust_order(spark, sf_dir):
    """A cluster for every vector: segments of the leaf order, which rows beyond the limit of a linkage join by the nearest centroid."""
    from strandlake.plans.pipeline import by_dendrogram_all

    rows = vectors(spark, sf_dir).select(F.col("id").alias("seq_id"), "class", F.col("x").alias("counts"))
    return by_dendrogram_all(spark, rows, 0.8)[0]


@query("ap_exemplars")
def ap_exemplars(spark, sf_dir):
    from strandlake.operators import ap

    return ap.per_class(vectors(spark, sf_dir))


@query("ap_two_stage")
def ap_two_stage(spark, sf_dir):
    """Both stages over every vector; those that are no class's exemplar have no cluster."""
    from strandlake.operators import ap

    return ap.two_stage(vectors(spark, sf_dir))


def _model(spark, sf_dir, method: str):
    """A model of the languages on all 3-mer counts."""
    from strandlake.operators import ml

    seqs = sequences(spark, sf_dir)
    parts = split.select_train_test(seqs, 60, 200, seed=7)
    names = K.all_kmers(k=3)

    def features(rows):
        return ml.motif_features(K.count_arrays(rows, 3), names, names)[0]

    train_rows = features(parts.train)
    return ml.train(train_rows, features(parts.test), names, method, cv_folds=0, rounds=5, trees=20), train_rows


@query("rf_fit_predict")
def rf_fit_predict(spark, sf_dir):
    return _model(spark, sf_dir, "rf")[0].predictions


@query("gbt_fit_predict")
def gbt_fit_predict(spark, sf_dir):
    return _model(spark, sf_dir, "xgb")[0].predictions


@query("feature_importance")
def feature_importance(spark, sf_dir):
    from strandlake.operators import explain

    return explain.feature_importance(spark, _model(spark, sf_dir, "xgb")[0])


@query("shap_values")
def shap_values(spark, sf_dir):
    from strandlake.operators import explain

    trained, rows = _model(spark, sf_dir, "rf")
    return explain.shap_values(trained, rows)


@query("pipeline_end_to_end")
def pipeline_end_to_end(spark, sf_dir):
    from strandlake.plans.pipeline import classify

    out = classify(spark, sequences(spark, sf_dir), k=3, n_motifs=32, seq_per_class=60, min_size=200, cv_folds=0, ml_method="rf", importance=False)
    return out.trained.predictions
