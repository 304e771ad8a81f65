import itertools
import random
import zlib

import numpy as np
import pytest

from strandlake.llm import toxicity as tox
from tests.llm.conftest import EDGES

INSULTS = ["stupid", "idiot", "moron", "pathetic", "loser"]
PLAIN = "the of and that with from they there other thing water under morning garden letter simple orange violet winter bread travel silver".split()


@pytest.fixture(scope="module")
def language(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(PLAIN + INSULTS) for _ in range(40)),) for _ in range(60)] + [(None,)]
    return tox.language_model(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize("noisy,plain", [("1d10t", "idiot"), ("$tup1d", "stupid"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("st*pid", "stupid"), ("mooooron", "moron"), ("l0ser", "loser"), ("p@thet1c", "pathetic"), ("LO$ER", "loser")])
def test_restores(language, noisy, plain):
    assert tox.restore(noisy, language) == plain
    assert plain in tox.Reader(language).features(f"well, {noisy} it is")


@pytest.mark.parametrize("noisy,words", [("a s t u p i d", ["a", "stupid"]), ("y o u i d i o t", ["you", "idiot"]), ("1 d 1 0 t", ["idiot"]), ("m 0 r 0 n", ["moron"]), ("1.d.1.0.t", ["idiot"]), ("stu.pid", ["stupid"]), ("id-iot", ["idiot"]), ("idiot.there", ["idiot", "there"])])
def test_spacing_is_decided(spark, noisy, words):
    rng = random.Random(2)
    texts = [(" ".join(rng.choice([*PLAIN, *INSULTS, "a", "you"]) for _ in range(40)),) for _ in range(60)]
    model = tox.language_model(spark.createDataFrame(texts, "text string"))
    assert tox.restore(noisy, model).split() == words
    assert set(words) <= tox.Reader(model).features(f"well, {noisy} then")


def test_viterbi_equals_enumeration(language):
    """Every path through the lattice, priced one by one."""

    def paths(arcs, i=0):
        if i == len(arcs):
            yield "", 0.0
            return
        for to, write, price in arcs[i]:
            for rest, cost in paths(arcs, to):
                yield write + rest, price + cost

    def price(text):
        s = [0, 0, *map(tox._symbol, text), 0]
        return sum(language.cost[s[i], s[i + 1], s[i + 2]] for i in range(len(s) - 2))

    for token in ("1d10t", "$1ll1", "aaab", "l00ser", "a*c", "s-1-t", "ooo0", "é1"):
        best = min(cost + price(text) for text, cost in paths(tox._arcs(token)))
        got = tox.restore(token, language)
        assert min(cost + price(text) for text, cost in paths(tox._arcs(token)) if text == got) == pytest.approx(best)


def test_trigram_counts(spark):
    def plain(texts):
        out = {}
        for t in texts:
            s = []
            for word in "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in t or ""):
                s.append(0 if word == " " else tox._symbol(word.lower()) if word.isascii() else 27)
            s = list(itertools.chain.from_iterable([0, 0] if x == 0 else [x] for x in s))
            for g in zip(s, s[1:], s[2:]):
                out[g] = out.get(g, 0) + 1
        return out

    import pyarrow as pa

    for texts in (["abc de"], ["abc de", "É1xy"], ["", "z", None, "A b  c", "éa É"]):
        (batch,) = tox._trigram_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]))
        got = {(int(g) // 784, int(g) // 28 % 28, int(g) % 28): n for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        # texts of a slice follow each other with an edge between them; a text's first character counts as that edge
        assert sum(got.values()) == sum(plain([joined(texts)]).values()) and got == plain([joined(texts)])


def joined(texts):
    """Texts as the counter sees a slice of them: the first character of each but the first is an edge."""
    some = [t for t in texts if t]
    return some[0] + "".join(" " + t[1:] for t in some[1:]) if some else ""


def labelled(n, seed):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(50)]
        bad = rng.random() < 0.3
        if bad:
            for w in rng.sample(INSULTS, 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_learns_and_scores_disguised_words(spark, make_docs):
    rows, marks = labelled(400, 3)
    model = tox.fit(make_docs(rows + EDGES), spark.createDataFrame(marks + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))
    assert {"stupid", "idiot"} <= set(model.names)
    test, truth = labelled(200, 8)
    hidden = [(i, t.replace("idiot", "1d10t").replace("stupid", "s t u p i d").replace("moron", "m0ron")) for i, t in test]
    for part in (test, hidden):
        got = {r["doc_id"]: r["score"] for r in tox.score(make_docs(part), model).collect()}
        assert np.mean([(got[i] >= tox.THRESHOLD) == bool(y) for i, _, y in truth]) > 0.98
    edge = tox.score(make_docs(EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r["score"] < tox.THRESHOLD for r in edge)


def test_no_labels_and_one_label(spark, make_docs):
    docs = make_docs([(i, "some words here") for i in range(8)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in tox.score(docs, tox.fit(docs, none)).collect()} == {0}
    one = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in tox.score(docs, tox.fit(docs, one)).collect()} == {0}
    assert tox.score(make_docs([]), tox.fit(make_docs([]), none)).collect() == []


@pytest.mark.parametrize("noisy,word", [("s t u p 1 d", "stupid"), ("s.t.u.p.1.d", "stupid"), ("st upid", "stupid"), ("st.upid", "stupid"), ("stuupiid", "stupid"), ("ｓｔｕｐｉｄ", "stupid"), ("ѕtupіd", "stupid"), ("mοrοn", "moron"), ("mor on", "moron"), ("lloser", "loser"), ("1 D 1 0 T", "idiot"), ("p4th3tic", "pathetic")])
def test_mixed_disguises(language, noisy, word):
    names = frozenset(tox._features_of(set(INSULTS)))
    got = tox.Reader(language, names).features(f"well, {noisy} then")
    assert got == tox._features_of({word})
    assert tox.Reader(language, names).features("the morning is on the letter of a low serial number, all good") == set()


def test_scores_equal_plain_ones(spark, make_docs):
    """The score is the logistic sum of the weights of the restored text's words and beginnings, restored by trying every path."""
    rows, marks = labelled(300, 5)
    model = tox.fit(make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))

    def paths(arcs, i=0):
        if i == len(arcs):
            yield "", 0.0
        else:
            for to, write, price in arcs[i]:
                for rest, cost in paths(arcs, to):
                    yield write + rest, price + cost

    def reading(word):
        s = lambda t: [0, 0, *map(tox._symbol, t), 0]
        price = lambda t: sum(model.language.cost[g] for g in zip(s(t), s(t)[1:], s(t)[2:]))
        return min((cost + price(t), t) for t, cost in paths(tox._arcs(word)))[1]

    texts = [(0, "water under the garden"), (1, "an 1d10t with m0ron winter"), (2, "$tup1d l0ser bread"), (3, "pathet1c"), (4, None), (5, "idiot stupid moron")]
    got = {r["doc_id"]: r["score"] for r in tox.score(make_docs(texts), model).collect()}
    for i, t in texts:
        words = [reading(w) if any(c in "01$" for c in w) else w for w in (t or "").split()]
        z = model.bias + sum(model.weights[k] for x, k in model.names.items() if any(w == x or (x.endswith("~") and len(w) >= len(x) - 1 and w.startswith(x[:-1])) for w in words))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_long_tokens_take_linear_time(language):
    import time

    reader, began = tox.Reader(language), time.time()
    for token in ("a1" * 50_000, "a" * 100_000, "*" * 50_000 + "a", "a.b" * 20_000, "x 1 " * 20_000):
        reader.features(token)
    assert time.time() - began < 60


def test_query_split(spark):
    got = tox.query(spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
