import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions import kmers as K
from strandlake.functions.sequences import drop_class, require_columns

SCHEMA = "seq_id long, class string, seq string"


def counts(sequence, k, alphabet="ACGT"):
    return {n: c for n, c in K.count_kmers(sequence, k, alphabet).counts.items() if c}


@pytest.mark.parametrize(
    "sequence,k,alphabet,expected,size",
    [
        ("AAAA", 2, "ACGT", {"AA": 3}, 16), ("ACGTACGT", 1, "ACGT", {"A": 2, "C": 2, "G": 2, "T": 2}, 4), ("ATAT", 2, "AT", {"AT": 2, "TA": 1}, 4), ("AAAA", 2, "A", {"AA": 3}, 1),
        ("acGTacgt", 2, "ACGT", {"AC": 2, "CG": 2, "GT": 2, "TA": 1}, 16), ("AAAAAAAAAA", 2, "ACGT", {"AA": 9}, 16), ("ACACACAC", 2, "ACGT", {"AC": 4, "CA": 3}, 16), ("ATCGATCG", 2, "ATCG", {"AT": 2, "TC": 2, "CG": 2, "GA": 1}, 16),
    ],
)
def test_single_sequence(sequence, k, alphabet, expected, size):
    got = K.count_kmers(sequence, k, alphabet)
    assert counts(sequence, k, alphabet) == expected and len(got) == size and got.total_kmers == len(sequence) - k + 1


@pytest.mark.parametrize("args", [("ACGT", "2"), ("ACGT", (1, 2)), ("ACGT", 0), ("ACGT", -1), ("ACGT", 2, 123), ("ACGT", 2, ""), ("ACGT", 2, "AAC"), (123, 2), ("", 2), ("ACGT", 5), ("ACGTN", 2), ("ACGT", True)])
def test_strictness(args):
    with pytest.raises(ValueError):
        K.count_kmers(*args)


def test_several_sequences_warn():
    with pytest.warns(UserWarning):
        assert K.count_kmers(["AAAA", "CCCC"], 2).counts["AA"] == 3


def test_views():
    got = K.count_kmers("ACGTACGTT", 2)
    assert list(got.counts) == sorted(got.counts) == K.all_kmers("ACGT", 2)
    assert got["AC"] == 2 and list(got.head(2).counts) == ["AA", "AC"] and list(got.tail(1).counts) == ["TT"] and list(got[1:3].counts) == ["AC", "AG"]
    assert got.top(1) == [("AC", 2)] and list(got.sort().counts)[-3:] == ["AC", "CG", "GT"]
    assert set(got.subset("^A").counts) == {"AA", "AC", "AG", "AT"}
    assert got.summary() == {"total_kmers": 8, "possible_kmers": 16, "observed_kmers": 5, "zero_kmers": 11, "min_count": 0, "max_count": 2, "mean_count": 0.5, "median_count": 0}
    with pytest.raises(ValueError):
        got.subset(None)
    with pytest.warns(UserWarning):
        assert not got.subset("X").counts
    assert "8 windows" in str(got)


def test_batch_skips_other_letters(spark):
    rows = [(1, "a", "ATCNGATCG"), (2, "a", "acgt"), (3, "b", ""), (4, "b", None), (5, None, "AAA"), (6, "b", "NNNNA")]
    df = spark.createDataFrame(rows, SCHEMA)
    per = {(r["seq_id"], r["kmer"]): r["n"] for r in K.count_by_sequence(df, 2).collect()}
    assert {k: n for k, n in per.items() if k[0] == 1} == {(1, "AT"): 2, (1, "TC"): 2, (1, "GA"): 1, (1, "CG"): 1}
    by_class = {(r["class"], r["kmer"]): r["n"] for r in K.count_by_class(df, 2).collect()}
    assert by_class == {("a", "AT"): 2, ("a", "TC"): 2, ("a", "GA"): 1, ("a", "CG"): 2, ("a", "AC"): 1, ("a", "GT"): 1, (None, "AA"): 2}
    dense = {r["seq_id"]: r["counts"] for r in K.count_arrays(df, 1).collect()}
    assert dense[1] == [2, 2, 2, 2] and dense[3] == dense[4] == [0] * 4 and dense[6] == [1, 0, 0, 0]


def test_alphabet_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "x", "ACGT")], SCHEMA)
    filled = K.zero_fill(K.count_by_class(df, 2, "AC"), "class", "AC", 2).orderBy("ord").collect()
    assert [(r["kmer"], r["n"]) for r in filled] == [("AA", 0), ("AC", 1), ("CA", 0), ("CC", 0)]
    assert [r["kmer"] for r in K.vocabulary(spark, "TA", 3).orderBy("ord").collect()] == K.all_kmers("TA", 3)
    assert K.count_by_class(spark.createDataFrame([], SCHEMA), 3).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTNacgt", max_size=30), max_size=8), st.integers(1, 5))
def test_codes_equal_plain_windows(seqs, k):
    import numpy as np

    data = "".join(seqs).encode()
    offsets = np.cumsum([0, *map(len, seqs)])
    code, row = K._codes(np.frombuffer(data, np.uint8), offsets, K.DNA, k)
    names = K.all_kmers(K.DNA, k)
    want = sorted((i, w) for i, s in enumerate(seqs) for w in K.windows(s.upper(), k) if set(w) <= set("ACGT"))
    assert sorted((int(r), names[c]) for c, r in zip(code, row)) == want


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, CLASS string")
    assert require_columns(df, ["x", "class"], "data").columns == ["x", "class"]
    with pytest.raises(ValueError, match="Missing columns in data: y, z"):
        require_columns(df, ["x", "y", "z"], "data")
    assert drop_class(df).columns == ["x"]
