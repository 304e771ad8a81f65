import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from strandlake.llm import packing
from strandlake.llm._text import slices
from strandlake.llm.tokens import WordTokenizer
from tests.llm.conftest import EDGES

PATH = packing.default_tokenizer()


def ids_of(texts):
    words = WordTokenizer.load(PATH)
    return [x.tolist() for _, d, o in slices(pa.array(texts, pa.string())) for x in words.encode(d, o)]


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    letters = "abcdeésñüßœŁABCÉÑ  \n\t.,!?-_'\"0123456789<|>½²ªµ×÷İſ漢字\U0001f600́\x0b\x1c\x85 Σς"
    texts = ["", None, "it's don't we'll ''s '", "<|endoftext|> a <|startoftext|>", "naïve ŒUVRE Łódź ǅ ȺȾ", "A1b22 3.5%", "word" * 3000]
    texts += ["".join(rng.choice(letters[: rng.choice((20, 40, len(letters)))]) for _ in range(rng.randrange(80))) for _ in range(600)]
    library = Tokenizer.from_file(PATH)
    assert ids_of(texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(texts) == ids_of(texts)  # from memory


def test_words_that_collide_under_polynomial_hashes():
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [one, one.translate(str.maketrans("ab", "ba")), f"{one} {one.translate(str.maketrans('ab', 'ba'))}"]
    library = Tokenizer.from_file(PATH)
    assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_token_encodes_to_itself():
    """Then merging by the rank of the joined bytes is merging by the rank of the pair, so the fast path is exact."""
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ends, inside = Tokenizer.from_file(PATH).model, models.BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
    for token, i in model["vocab"].items():
        if not token.startswith("<|"):
            got = ends.tokenize(token[:-4]) if token.endswith("</w>") else inside.tokenize(token)
            assert [x.id for x in got] == [i]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("strandlake.llm.tokens.REMEMBERED", 20)
    words = WordTokenizer(PATH)
    texts = [f"alpha{i} beta{i} gamma" for i in range(60)]
    got = [x.tolist() for t in texts for _, d, o in slices(pa.array([t])) for x in words.encode(d, o)]
    assert got == [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts] and len(words.known) <= 23


def slow_sum_of_squares(lengths, size):
    bins, out = [], []
    for n in lengths:
        def total(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        choices = [(total([size - b for b in bins] + [size - n]), 1, 0, len(bins))]
        for i, b in enumerate(bins):
            if b + n <= size and b < size:
                after = [size - (x + n if j == i else x) for j, x in enumerate(bins)]
                choices.append((total(after), 0, size - b - n, i))
        best = min(c[:3] for c in choices)
        at = [c[3] for c in choices if c[:3] == best][-1]
        if at == len(bins):
            bins.append(0)
        bins[at] += n
        out.append((best[0], bins[at]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_each_place_makes_the_sum_of_squares_smallest(seed):
    rng = random.Random(seed)
    size = 12
    lengths = [rng.randrange(1, size + 1) for _ in range(40)]
    where = packing.sum_of_squares(np.array(lengths), size)
    load, got = {}, []
    for n, b in zip(lengths, where):
        load[b] = load.get(b, 0) + n
        assert load[b] <= size
        gaps = [size - x for x in load.values()]
        got.append((sum(gaps.count(g) ** 2 for g in set(gaps) if g), load[b]))
    assert [g[0] for g in got] == [s[0] for s in slow_sum_of_squares(lengths, size)]


def test_gaps_are_filled():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 900, 4000))[::-1]
    first = packing.sum_of_squares(lengths, 2048)
    where = packing.dissolve(lengths, first, 2048)
    load = np.bincount(where, weights=lengths)
    assert load.max() <= 2048 and len(set(where.tolist())) <= len(set(first.tolist()))
    assert len(set(where.tolist())) <= 1.01 * -(-lengths.sum() // 2048)


def test_pieces_and_places(make_docs):
    rows = [*EDGES, *[(100 + i, "some words here " * (i * 7 % 50)) for i in range(120)]]
    got = [r.asDict() for r in packing.pack(make_docs(rows), size=64).collect()]
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert len(bins) <= 1.01 * sum(r["length"] for r in got) / 64 + 2


def test_several_groups_and_empty_table(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    got = packing.pack(make_docs([(1, "same text")] * 300), size=32).collect()
    assert len(got) == 300 and len({r["sequence_id"] >> 32 for r in got}) > 3
    assert packing.pack(make_docs([])).collect() == []
