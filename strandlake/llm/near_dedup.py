"""Near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._graph import components
from strandlake.llm._memory import released
from strandlake.llm._store import cut, pick, scratch, small_or_shuffled, spread
from strandlake.llm._text import mix, shingle_sets, slices

#: Signature rows of a band, and the most likely miss of a pair at exactly the threshold.
BAND_ROWS, MISS = 6, 1e-6
#: Documents of a large bucket, and bytes of their sets, that one verification task holds from either side, about.
CHUNK, CHUNK_BYTES = 256, 4 << 20
#: Bytes of sets that one task of small buckets holds, about.
TASK_BYTES = 2 << 20
#: Shingles whose ranks are drawn at once.
_AT_ONCE = 1 << 16
#: Levels after which the few shingles left get whole permutations.
_SPARSE_LEVELS = 16


def bands_for(percent: int) -> int:
    """Bands of BAND_ROWS rows so that a pair of similarity percent / 100 is missed with probability MISS at most."""
    p = min((percent / 100) ** BAND_ROWS, 1 - 1e-9)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - p)))


def _draw(h: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's random number in [0, 1) and its swap partner in [level, m) at a level."""
    x = mix(h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(32)).astype(np.float64) / 4294967296.0, level + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)


def superminhash(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (sets by m) of sets of hashes h[bounds[i]:bounds[i+1]]; rows of empty sets stay infinite.

    Each element visits the m places in a random order of its own, and at its
    j-th place offers j plus a random number.  A place keeps the smallest offer,
    so the ranks of one element's offers depend on each other and the estimate
    varies less than with independent hashes.  A set is done as soon as all its
    places hold less than the level, since later offers are larger.
    """
    sets = len(bounds) - 1
    sig = np.full((sets, m), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    flat = sig.reshape(-1)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    perm = None
    for level in range(m):
        if not len(h):
            break
        r, k = _draw(h, level, m)
        if perm is None:
            here, there = np.full(len(h), level), k.copy()
            for place, value in swaps:
                here = np.where(place == level, value, here)
                there = np.where(place == k, value, there)
            swaps.append((k, here))
        else:
            i = np.arange(len(h))
            here, there = perm[i, level], perm[i, k]
            perm[i, k] = here
        np.minimum.at(flat, owner * m + there, r + level)
        open_set = sig.max(axis=1) > level + 1
        alive = open_set[owner]
        if not alive.any():
            break
        if perm is None and level + 1 == min(_SPARSE_LEVELS, m):
            perm = np.broadcast_to(np.arange(m, dtype=np.int32), (len(h), m)).copy() if alive.all() else None
            if perm is None:
                h, owner = h[alive], owner[alive]
                swaps = [(p[alive], v[alive]) for p, v in swaps]
                perm = np.broadcast_to(np.arange(m, dtype=np.int32), (len(h), m)).copy()
            i = np.arange(len(h))
            for place, value in swaps:
                perm[i, place] = value
            swaps = []
        elif alive.mean() < 0.7:
            h, owner = h[alive], owner[alive]
            swaps = [(p[alive], v[alive]) for p, v in swaps]
            perm = perm[alive] if perm is not None else None
    return sig


def _signatures(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """superminhash() over sets of like size at a time, so that few draws are made for sets that are done."""
    size = np.diff(bounds)
    out = np.full((len(size), m), np.inf)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    begin = 0
    while begin < len(order):
        total = np.cumsum(size[order[begin:]])
        # small sets may end up with whole permutations, so fewer of them go at once
        limit = _AT_ONCE if size[order[begin]] >= 64 else _AT_ONCE // 4
        end = begin + max(1, int(np.searchsorted(total, limit, "right")))
        part = order[begin:end]
        elements = np.concatenate([h[bounds[d] : bounds[d + 1]] for d in part])
        out[part] = superminhash(elements, np.r_[0, np.cumsum(size[part])], m)
        begin = end
    return out


def _prints(h: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums of each set, equal for equal sets; 0 for empty ones."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
            out[i, some] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), bounds[some]))
    return [pa.array(x.view(np.int64)) for x in out]


@released
def _sign_batches(batches: Iterator[pa.RecordBatch], k: int, bands: int) -> Iterator[pa.RecordBatch]:
    m = bands * BAND_ROWS
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            h, bounds = shingle_sets(data, offsets, k)
            n = len(offsets) - 1
            sig = _signatures(h, bounds, m).view(np.uint64).reshape(n, bands, BAND_ROWS)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
            for r in range(BAND_ROWS):
                key = mix(key * np.uint64(0xD1342543DE82EF95) + sig[:, :, r])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(bounds)), *_prints(h, bounds), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])


@released
def _set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            h, bounds = shingle_sets(data, offsets, k)
            raw = h.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), *_prints(h, bounds), sets], names=["node", "f1", "f2", "hashes"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded list of sets, by products of incidence blocks."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        out = np.zeros((2, 2))
        out[0, 1] = out[1, 0] = (both[1:] == both[:-1]).sum()
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    owner, col = owner[keep], (np.cumsum(count > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n), np.float64)
    width = 4096
    for begin in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (begin, begin + width))
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], col[a:b] - begin] = 1
        out += block @ block.T
    return out


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join two trees of a union-find as they come: enough links to span all groups."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _links(u: list, v: list) -> pd.DataFrame:
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _groups(task: pd.DataFrame) -> Iterator[np.ndarray]:
    """Row numbers of each group of a task."""
    order = np.argsort(task["grp"].to_numpy(), kind="stable")
    name = task["grp"].to_numpy()[order]
    yield from np.split(order, np.flatnonzero(name[1:] != name[:-1]) + 1)


def _verify_stars(task: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links from the hub of each group of a task to those of its other rows whose sets are similar enough."""
    u, v = [], []
    ids, hub, sets = task["node"].to_numpy(), task["hub"].to_numpy(), task["hashes"].to_numpy()
    for rows in _groups(task):
        others = rows[~hub[rows]]
        part = [np.frombuffer(sets[i], np.uint64) for i in others]
        size = np.array([len(x) for x in part])
        for at in rows[hub[rows]] if len(others) else ():
            own = np.frombuffer(sets[at], np.uint64)
            every = np.concatenate(part)
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            inter = np.bincount(np.repeat(np.arange(len(part)), size)[own[place] == every], minlength=len(part))
            for i in others[100 * inter >= percent * (size + len(own) - inter)]:
                u.append(ids[at])
                v.append(ids[i])
    return _links(u, v)


def _verify_rest(task: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning links among the rows of each group of a task that no link joins yet and whose sets are similar enough; of two different chunks, only links between them."""
    u, v = [], []
    for rows in _groups(task):
        if len(rows) < 2:
            continue
        group = task.iloc[rows]
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
        ids, chunk, comp = group["node"].to_numpy(), group["chunk"].to_numpy(), group["comp"].to_numpy()
        size = np.array([len(s) for s in sets], np.float64)
        inter = _overlaps(sets)
        linked = (100 * inter >= percent * (size[:, None] + size[None, :] - inter)) & (comp[:, None] != comp[None, :])
        if len(set(chunk)) > 1:
            linked &= chunk[:, None] != chunk[None, :]
        for i, j in _forest(np.argwhere(np.triu(linked, 1)), len(ids)):
            u.append(ids[i])
            v.append(ids[j])
    return _links(u, v)


def _pieces(rows: Column, sizes: Column) -> Column:
    """Chunks that so many rows, whose sets have so many shingles in all, are dealt into."""
    return F.greatest(F.ceil(rows / CHUNK), F.ceil(sizes * 8 / CHUNK_BYTES)).cast("int")


def _dealt(name: str, pieces: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(pieces)).cast("int")


def _tasks(rows: DataFrame) -> int:
    """Tasks that the small groups of rows (with sizes n) are spread over."""
    return max(1, math.ceil(8 * (rows.agg(F.sum("n")).first()[0] or 0) / TASK_BYTES))


def _star_links(member: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the hub of a bucket and its other members: each pair is checked once, however many bands it shares."""
    edges = member.where("node <> u").select("u", "node").distinct().join(sizes, "node").select("u", F.col("node").alias("v"), "n")
    edges = edges.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("un")), "u")
    edges = cut(edges.where(f"100 * least(n, un) >= {percent} * greatest(n, un)"), "stars")
    sized = cut(edges.groupBy("u").agg(_pieces(F.count("*"), F.sum("n") + F.first("un")).alias("pieces")), "star-sizes")
    leaf = edges.join(small_or_shuffled(sized, 16), "u").select(F.col("u").alias("grp"), "pieces", _dealt("v", "pieces").alias("chunk"), F.col("v").alias("node"), F.lit(False).alias("hub"))
    head = sized.select(F.col("u").alias("grp"), "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("chunk"), F.col("u").alias("node"), F.lit(True).alias("hub"))
    # hubs of one piece share a task with others; larger ones have a task for each piece
    task = F.when(F.col("pieces") == 1, F.struct(F.lit(0).cast("long").alias("g"), F.pmod(F.xxhash64("grp"), F.lit(_tasks(edges))).cast("int").alias("c"), F.lit(False).alias("large")))
    task = task.otherwise(F.struct(F.col("grp").alias("g"), F.col("chunk").alias("c"), F.lit(True).alias("large")))
    work = sets.join(leaf.unionByName(head), "node").select(task.alias("task"), "grp", "node", "hub", "hashes")
    return cut(work.groupBy("task").applyInPandas(partial(_verify_stars, percent=percent), "u long, v long"), "star-links")


def _rest_links(member: DataFrame, sizes: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (u, v) between members of one bucket, hubs aside, that found (node, component) does not join yet.

    Buckets of equal members are checked once.  In a large bucket, components
    that fill a chunk have chunks of their own, which are never paired with each
    other; the rest is dealt into chunks, and each two chunks are a task.
    """
    rest = member.where("node <> u").select("band", "node").join(sizes, "node").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    rest = cut(rest, "rest-members")
    hashes = [F.sum(F.xxhash64("node", F.lit(salt)).cast("decimal(20)")).alias(f"s{salt}") for salt in (0, 1)]
    open_ = rest.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"), *hashes, _pieces(F.count("*"), F.sum("n")).alias("pieces"))
    open_ = open_.where("low < high").groupBy("rows", "s0", "s1").agg(F.min(F.struct("band", "pieces")).alias("b")).select("b.*")
    rest = cut(rest.join(small_or_shuffled(cut(open_, "rest-bands"), 20), "band"), "rest-open")
    if rest.isEmpty():
        return None
    single = rest.where("pieces = 1").withColumn("chunk", F.lit(0).cast("long"))
    task = F.struct(F.pmod(F.xxhash64("band"), F.lit(_tasks(rest))).alias("b"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(True).alias("small"))
    placed = single.select(task.alias("task"), F.col("band").alias("grp"), "node", "comp", "chunk")
    large = rest.where("pieces > 1")
    if not large.isEmpty():
        placed = placed.unionByName(_chunked(large))
    work = sets.join(placed, "node").select("task", "grp", "node", "comp", "chunk", "hashes")
    return cut(work.groupBy("task").applyInPandas(partial(_verify_rest, percent=percent), "u long, v long"), "rest-links")


def _chunked(rest: DataFrame) -> DataFrame:
    """(task, grp, node, comp, chunk): members (band, node, n, comp) of large buckets, once for each task of two chunks that they take part in."""
    own = rest.groupBy("band", "comp").agg(_pieces(F.count("*") * 2, F.sum("n") * 2).alias("half")).where("half > 1").select("band", "comp", F.col("comp").alias("own"))
    rest = rest.select("band", "node", "n", "comp").join(small_or_shuffled(cut(own, "rest-own"), 24), ["band", "comp"], "left")
    kind = F.struct(F.col("own").isNotNull().alias("large"), F.coalesce("own", F.lit(0)).alias("own")).alias("kind")
    rest = cut(rest.select("band", "node", "n", "comp", kind), "rest-kinds")
    sized = cut(rest.groupBy("band", "kind").agg(_pieces(F.count("*"), F.sum("n")).alias("pieces")), "rest-sizes")
    # a chunk's number is the hash of what it is; chunks of one component are never paired
    chunks = sized.select("band", "kind", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("c")).select("band", F.struct("kind", F.xxhash64("kind", "c").alias("id")).alias("chunk"))
    chunks = chunks.groupBy("band").agg(F.collect_list("chunk").alias("every"))
    placed = rest.join(sized, ["band", "kind"]).join(chunks, "band").withColumn("chunk", F.xxhash64("kind", _dealt("node", "pieces").alias("c")))
    other = F.explode(F.filter("every", lambda e: ~(e["kind"]["large"] & (e["kind"] == F.col("kind"))))["id"])
    placed = placed.select("band", "node", "comp", "chunk", other.alias("other"))
    task = F.struct(F.col("band").alias("b"), F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), F.lit(False).alias("small"))
    return placed.select(task.alias("task"), F.col("band").alias("grp"), "node", "comp", "chunk")


def _linked(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the classes (node, f1, f2, n, bands) that links join."""
    key = classes.select("node", F.explode("bands").alias("band"))
    hubs = key.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top").select("band", "u")
    member = cut(key.join(hubs, "band"), "members")
    nodes = cut(member.select("node").distinct().join(classes.select("node", "n"), "node"), "nodes")
    sizes = small_or_shuffled(nodes, 24)
    texts = docs.join(sizes, docs["doc_id"] == nodes["node"], "left_semi")
    sets = cut(texts.mapInArrow(partial(_set_batches, k=shingle), "node long, f1 long, f2 long, hashes binary").where(F.length("hashes") > 0), "sets")
    same = ["node", "f1", "f2"]
    if not sets.groupBy(*same).count().where("count > 1").isEmpty():
        sets = cut(sets.groupBy(*same).agg(F.first("hashes").alias("hashes")), "sets")
    # a doc_id may occur with other texts, of which other rows are the classes
    sets = sets.join(classes.select(*same), same, "left_semi").select("node", "hashes")
    links = _star_links(member, sizes, sets, percent)
    found = components(links)
    more = _rest_links(member, sizes, found, sets, percent)
    return found if more is None or more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``percent`` / 100.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links
    reach), kept (doc_id is component_id), a row for each row of docs.

    Equal sets are one class from the start.  Classes that share a band of the
    SuperMinHash signature are a bucket.  Every member of a bucket is checked, on
    full sets, against the bucket's hub, and what links is joined.  Only where a
    bucket's members still lie in several components are those checked against
    each other, in tasks of at most two chunks of CHUNK classes that return
    spanning links only.  So a group of copies costs about one check a member, and
    chains of buckets never become one group.  A pair at the threshold shares no
    band with probability MISS at most; no other link is lost.

    Words are runs without ASCII white space, with A-Z lower-cased.  A document
    of fewer words has its whole sequence as its one shingle.  Null, empty and
    blank texts have no set, link with nothing and keep their own doc_id.  Rows
    that repeat a doc_id with the same set are one document; with other sets, each
    row has its own links, and sets whose smallest doc_id is equal join.  A null
    doc_id stays alone and is kept.  Extra columns are ignored.  No rows give none.
    """
    docs = spread(pick(docs, "doc_id", "text"))
    bands = bands_for(percent)
    signed = docs.mapInArrow(partial(_sign_batches, k=shingle, bands=bands), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")
    signed = cut(signed, "signatures")
    some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    with scratch(docs.sparkSession) as kept:
        classes = signed.where(some).groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        classes = cut(classes, "classes")
        found = _linked(docs, classes, shingle, percent)
        top = cut(classes.select("f1", "f2", "node").join(found, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component_id")), "tops")
        kept.append(top)
    # documents without a set have no class to look up
    alone = signed.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = signed.where(some).join(top, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's component at three words and 85 %: nulls, repeated rows and empty tables as near_duplicates() states."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# two sets of which 100 * intersection >= 85 * union share one of the n - ceil(85 n / 100) + 1 rarest shingles of either, so only those are joined
SQL = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, list_sort(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
placed AS (SELECT r, doc_id, len(s) AS n, s, min(r) OVER same AS class, min(doc_id) OVER same AS node FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL WINDOW same AS (PARTITION BY s)),
classes AS (SELECT class, node, n, s FROM placed WHERE r = class),
parts AS (SELECT class, n, unnest(s) AS k FROM classes),
rare AS (SELECT class, n, k, row_number() OVER (PARTITION BY class ORDER BY f, k) AS place FROM (SELECT *, count(*) OVER (PARTITION BY k) AS f FROM parts)),
first AS (SELECT class, n, k FROM rare WHERE place <= n - (85 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.class AS x, b.class AS y FROM first a JOIN first b ON a.k = b.k AND a.class < b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT a.node AS u, b.node AS v, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS common FROM pairs JOIN classes a ON a.class = x JOIN classes b ON b.class = y),
links AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM shared WHERE 100 * common >= 85 * (total - common) UNION ALL SELECT v, u FROM shared WHERE 100 * common >= 85 * (total - common))),
reached(node, low) AS (SELECT DISTINCT node, node FROM classes UNION SELECT v, low FROM reached JOIN links ON u = node WHERE low < v),
tops AS (SELECT node, min(low) AS low FROM reached GROUP BY node),
found AS (SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(tops.low, sets.doc_id) AS component_id FROM sets LEFT JOIN placed USING (r) LEFT JOIN tops ON tops.node = placed.node)
SELECT doc_id, n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM found
"""
