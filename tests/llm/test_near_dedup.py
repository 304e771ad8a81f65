import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from strandlake.llm import near_dedup as nd
from strandlake.llm._graph import components
from strandlake.llm._text import shingle_sets, slices, span_hashes
from tests.llm.conftest import EDGES


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (i, a), (j, b) in combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None], 2):
        n = len(a & b)
        if i != j and n and 100 * n >= percent * len(a | b):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)], key=str)


def corpus(seed):
    """Texts with near copies of rising distance, chains, copies, and passages in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(rng.choice((8, 40, 120)))] for _ in range(12)]
    passage = [word() for _ in range(25)]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w += passage
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(make_docs, k, percent):
    rows = corpus(k) + [(1000 + (i or 0) if i is not None else None, t) for i, t in EDGES if t is None or len(t) < 50000] + [(2000, "A b"), (2001, "a  B"), (2002, "a b c")]
    got = nd.near_duplicates(make_docs(rows), k, percent)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, k, percent)


def test_sql_says_the_same(spark, tmp_path, make_docs):
    rows = corpus(3) + [(1000 + i, t) for i, t in EDGES if i not in (None, 7)] + [(2000, "A b"), (2001, "a  B"), (2002, "a b c")]
    make_docs(rows, clash=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in nd.query(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(nd.SQL).fetchall()) == sorted(brute(rows, 3, 85))


def test_groups_of_several_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 8)
    rows = corpus(9)
    assert sorted([tuple(r) for r in nd.near_duplicates(make_docs(rows), 3, 85).collect()], key=str) == brute(rows, 3, 85)


THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))


def test_crafted_words_are_no_copies(make_docs):
    """Words that collide under polynomial hashes modulo a power of two."""
    other = THUE_MORSE.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{THUE_MORSE} x y"), (2, f"{other} x y"), (3, f"{THUE_MORSE}  X y")]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_word_hashes():
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33, 70)))).encode() for _ in range(20000)}
    words |= {b"a" * n for n in range(1, 100)}
    words, at = sorted(words), [0]
    for w in words:
        at.append(at[-1] + len(w))
    data, at = np.frombuffer(b"".join(words), np.uint8), np.array(at)
    h = span_hashes(data, at[:-1], at[1:])
    assert len(set(h.tolist())) == len(words)
    # a word's hash does not depend on what stands around it
    for i in (0, 5, len(words) - 1):
        one = np.frombuffer(words[i], np.uint8)
        assert span_hashes(one, np.array([0]), np.array([len(one)]))[0] == h[i]


def chain(n, words, seed=2):
    """n texts, each the last one moved on by two words: neighbours link, far ones share nothing."""
    rng = random.Random(seed)
    stream = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words + 2 * n)]
    return [(i, " ".join(stream[2 * i : 2 * i + words])) for i in range(n)]


def test_a_chain_is_one_component(make_docs):
    got = nd.near_duplicates(make_docs(chain(800, 100)), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_a_bucket_of_several_components(make_docs, monkeypatch):
    """Texts that share bands but link in part only, in buckets of several chunks."""
    monkeypatch.setattr(nd, "CHUNK", 4)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(60)], []
    for i in range(120):
        w = list(base)
        # one of six variants of the base, and up to two words of its own
        w[10 * (i % 6) : 10 * (i % 6) + 4] = [f"v{i % 6}"] * 4
        for _ in range(rng.choice((0, 1, 2))):
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    assert sorted(tuple(r) for r in nd.near_duplicates(make_docs(rows), 3, 85).collect()) == sorted(brute(rows, 3, 85))


def test_one_row_many_times(make_docs):
    rows = [(5, "a b c d e f")] * 50 + [(5, "p q r s t")] * 50 + [(3, "p q r s t")] + [(9, "z " + "a b c d e f " * 30)]
    got = {tuple(r) for r in nd.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert got == {(5, 4, 5, True), (5, 3, 3, False), (3, 3, 3, True), (9, 7, 9, True)}


def test_empty_table(make_docs):
    assert nd.near_duplicates(make_docs([])).collect() == []


def test_sets_equal_plain_ones():
    import pyarrow as pa

    texts = ["", "a", "A b", "a b c", "a b c a b c", "x" * 5000, "é É b c", " \t\n", "a\x0bb\x0cc\rd", "w " * 9000, None]
    for k in (1, 3, 5):
        sizes = np.concatenate([np.diff(b) for _, d, o in slices(pa.array(texts)) for _, b in [shingle_sets(d, o, k)]])
        assert sizes.tolist() == [len(shingles(t, k)) for t in texts]
        for t in texts:  # one text a slice
            (sizes,) = [np.diff(b) for _, d, o in slices(pa.array([t], pa.string())) for _, b in [shingle_sets(d, o, k)]]
            assert sizes.tolist() == [len(shingles(t, k))]


@pytest.mark.parametrize("n,share", [(300, 0.85), (30, 0.5)])
def test_signatures_estimate_similarity_with_less_variance(n, share):
    rng, m, errors = np.random.default_rng(1), 192, []
    inter = round(2 * n * share / (1 + share))
    for _ in range(60):
        u = rng.integers(0, 1 << 62, 2 * n - inter).astype(np.uint64)
        sig = nd._signatures(np.r_[np.sort(u[:n]), np.sort(u[n - inter :])], np.array([0, n, 2 * n]), m)
        errors.append((sig[0] == sig[1]).mean() - inter / (2 * n - inter))
    independent = (share * (1 - share) / m) ** 0.5
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < independent * 1.05


def test_an_element_offers_every_place_once():
    """With one element the signature is j + r over a permutation of the places."""
    sig = nd.superminhash(np.array([12345], np.uint64), np.array([0, 1]), 60)[0]
    assert sorted(np.floor(sig).astype(int)) == list(range(60))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (30, 31), (31, 30), *[(100, i) for i in range(101, 140)], (139, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 5, 8: 5, 7: 5, 6: 5, 5: 5, 30: 30, 31: 30, **{i: 100 for i in range(100, 140)}, 200: 100}


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_paths_take_few_rounds(spark, order):
    n = 1000
    name = list(range(n + 1)) if order == "ascending" else list(range(n, -1, -1))
    if order == "shuffled":
        random.Random(1).shuffle(name)
    edges = [(name[i], name[i + 1]) for i in range(n)]
    rounds = []
    got = components(spark.createDataFrame(edges, "u long, v long"), closing=0, rounds=rounds).collect()
    assert {r["component"] for r in got} == {0} and len(got) == n + 1
    assert len(rounds) <= 10 and sum(rounds) <= 20


@pytest.mark.parametrize("closing", [0, 40, 1 << 20])
def test_components_of_random_graphs(spark, closing):
    rng = random.Random(closing)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(190)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), closing=closing).collect()}
    assert got == {a: find(a) for a in list(root)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
