"""Toxicity: noisy-channel restoration of disguised words by Viterbi decoding, then scoring of the restored text."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._memory import released
from strandlake.llm._store import cut, pick, spread
from strandlake.llm._text import slices

#: The most labelled rows that the classifier is fitted on, and the most features it has.
TRAIN_ROWS, FEATURES = 24_000, 600
#: A feature is in at least this many of the fitted rows.
SUPPORT = 5
#: Lengths of word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

#: What a character may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Letters of other alphabets that look like Latin ones (fixed values).
LOOKS = dict(zip("асеіјорѕухһԁαβεικνορτυχ", "aceijopsyxhdabeiknoptux"))
#: Characters that hide any letter, and those that are put between letters (fixed values).
MASKS, SEPARATORS = "*#", " .-_*~'"
#: Costs, in nats, of a stand-in, a hidden letter, a dropped separator, one that ends a word, and of a run of letters read as one or as two (fixed values).
SWAP_COST, MASK_COST, DROP_COST, KEEP_COST, RUN_COST = 0.7, 2.0, 0.2, 0.2, 0.3
#: How the end of a word and the begin of the next are written: two edges, as the language model counts them.
GAP = "  "

_EDGE, _OTHER, _SYMBOLS = 0, 27, 28
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = _OTHER

_LEETS = re.escape("".join(LEET))
_WORD = re.compile(r"[^\W\d_]+")
#: Letters, stand-ins or masks spelled one by one: s t u p i d, s.t.u.p.i.d, 1 d 1 0 t.
_ONE = rf"(?:[^\W_]|[{_LEETS}{MASKS}])"
_SPELLED = re.compile(rf"(?<![^\W_]){_ONE}(?:[ .\-_*~']{{1,3}}{_ONE}(?![^\W_])){{2,}}")
#: Stretches of a token that may be one disguised word: letters mixed with stand-ins, masks or look-alikes (1d10t, $tup1d, mor*n), with separators (stu.pid), or with a letter twice or more (stuupiid).
_STRETCH = re.compile(rf"[\w{_LEETS}{MASKS}\-.~']+")
_SPLIT = re.compile(r"[^\W_][.\-_~']+[^\W_]")
_MARKS = re.compile(r"^[^\w]{2,}|[^\w]{2,}$")
_RUN = re.compile(r"([^\W\d_])\1")
_RUNS = re.compile(r"([^\W\d_])\1+")
_LATIN = re.compile("[a-z]")
_NOISE = frozenset(LEET) | frozenset(MASKS) | frozenset(LOOKS)
#: Longer stretches are decoded in parts of so many characters, each of which overlaps the last by half.
PART = 64
#: Distinct tokens that a worker remembers; beyond, it starts anew, which costs time only.
REMEMBERED = 500_000


@dataclass(frozen=True)
class LanguageModel:
    """Costs (negative log probabilities) of a letter after two others; letters are 0 (edge), 1-26 and 27 (any other)."""

    cost: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> "LanguageModel":
        """From trigram counts, mixed with bigram and single-letter shares so that nothing is impossible."""
        c = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
        one = (c.sum((0, 1)) + 1) / (c.sum() + _SYMBOLS)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
        three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
        return LanguageModel(-np.log(0.9 * three + 0.09 * two[None] + 0.01 * one))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _EDGE if c == " " else _OTHER


def _arcs(token: str) -> list[list[tuple[int, str, float]]]:
    """The lattice: from each position, (next position, letters written, cost)."""
    n = len(token)
    letters = [c.isalpha() for c in token]
    out: list[list[tuple[int, str, float]]] = []
    for i, c in enumerate(token):
        run = i + 1
        while run < n and token[run] == c:
            run += 1
        here: list[tuple[int, str, float]] = []
        reads = [(c, 0.0)] if letters[i] else [(x, SWAP_COST) for x in LEET.get(c, "")]
        if c in LOOKS:
            reads.append((LOOKS[c], SWAP_COST))
        for x, cost in reads:
            here.append((i + 1, x, cost))
            if run - i >= 2:
                here.append((run, x, cost + RUN_COST))
            if run - i >= 3:
                here.append((run, x + x, cost + RUN_COST))
        if c in MASKS:
            here += [(i + 1, chr(x), MASK_COST) for x in range(97, 123)]
        if c in SEPARATORS and 0 < i < n - 1:
            here += [(i + 1, "", DROP_COST), (i + 1, GAP, KEEP_COST)]
        if not here:
            here.append((i + 1, c, 0.0))
        out.append(here)
    return out


def restore(token: str, model: LanguageModel) -> str:
    """The cheapest reading of a token under channel and language model: Viterbi over (position, last two letters)."""
    token = token.lower()
    arcs = _arcs(token)
    best: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(token) + 1)]
    best[0][0, 0] = (0.0, "")
    cost = model.cost
    for i, here in enumerate(arcs):
        for (a, b), (c, text) in best[i].items():
            for to, write, price in here:
                p, q, total = a, b, c + price
                for x in write:
                    s = _symbol(x)
                    total += cost[p, q, s]
                    p, q = q, s
                old = best[to].get((p, q))
                if old is None or (total, text + write) < old:
                    best[to][p, q] = (total, text + write)
        best[i] = {}
    return min(((c + cost[a, b, _EDGE], text) for (a, b), (c, text) in best[-1].items()), default=(0.0, token))[1]


def _features_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a tilde."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "~" for w in words if len(w) >= n])
    return out


def _single(word: str) -> str:
    """The word with each run of a letter as one."""
    return _RUNS.sub(r"\1", word)


class Reader:
    """Features of restored texts; with ``wanted``, those among it only. Tokens that were read before are remembered.

    Text is brought to compatibility form (full-width letters become plain ones)
    and lower case.  Runs spelled letter by letter are read first, then each
    token's stretches that may be disguised; what is read takes the place of what
    stood there.  With ``wanted``, a stretch whose only sign is a doubled letter is
    read if it could be a wanted word or beginning, and two tokens that make a
    wanted word together are read as one with a blank in it.
    """

    def __init__(self, model: LanguageModel, wanted: frozenset | None = None) -> None:
        self.model, self.wanted = model, wanted
        self.known: set[str] = set()
        self.telling: dict[str, frozenset] = {}
        self.words = frozenset(x for x in wanted or () if not x.endswith("~"))
        self.singles = frozenset(_single(x.rstrip("~")) for x in wanted or ())
        self.lengths = sorted({len(x) for x in self.singles})

    def read(self, run: str) -> str:
        """A run restored, in parts if it is long; marks around it stay out of it."""
        core = run.strip(MASKS + SEPARATORS)
        if not _WORD.search(core) or len(core) < 3:
            return run
        return " ".join(restore(core[i : i + PART], self.model) for i in range(0, max(1, len(core) - PART // 2), PART // 2))

    def _disguised(self, stretch: str) -> bool:
        if not _LATIN.search(stretch):
            return False
        if not _NOISE.isdisjoint(stretch) or _SPLIT.search(stretch):
            return True
        if not _RUN.search(stretch):
            return False
        single = _single(stretch)
        return self.wanted is None or any(single[:n] in self.singles for n in self.lengths if n <= len(single))

    def _stretch(self, m: re.Match) -> str:
        # marks that end a word stand for no letter, nor do rows of them before or after it
        stretch = _MARKS.sub("", m.group()).strip(MASKS + SEPARATORS).rstrip("!|+(")
        if not self._disguised(stretch):
            return m.group()
        return " " + " ".join(restore(stretch[i : i + PART], self.model) for i in range(0, max(1, len(stretch) - PART // 2), PART // 2)) + " "

    def token_features(self, token: str) -> frozenset:
        """Features of the words of a token whose disguised stretches are restored."""
        found = _features_of(set(_WORD.findall(_STRETCH.sub(self._stretch, token))))
        return frozenset(found if self.wanted is None else found & self.wanted)

    def features(self, text: str) -> set[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        text = _SPELLED.sub(lambda m: self.read(m.group()), text.lower())
        tokens = text.split()
        out: set[str] = set()
        if self.words:
            for a, b in zip(tokens, tokens[1:]):
                if a + b in self.words:
                    out |= self.token_features(restore(f"{a} {b}", self.model))
        if len(self.known) > REMEMBERED:
            self.known, self.telling = set(), {}
        tokens = set(tokens)
        new = tokens - self.known
        self.known |= new
        for token in new:
            found = self.token_features(token)
            if found:
                self.telling[token] = found
        # most tokens tell nothing, so look-ups that find nothing are the common case
        for found in filter(None, map(self.telling.get, tokens)):
            out |= found
        return out


@released
def _trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            s = _CLASS[data]
            # continuation bytes would count an accented letter twice
            keep = (data & 0xC0) != 0x80
            edge = np.zeros(len(data), bool)
            edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
            s[edge] = _EDGE
            s = s[keep]
            # two edges stand before a word, one after
            s = np.insert(s, np.flatnonzero(s == _EDGE), _EDGE)
            if len(s) > 2:
                total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=_SYMBOLS**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


def language_model(texts: DataFrame) -> LanguageModel:
    """A character trigram model of all rows of a column of texts; tasks return their counts of at most 28 ** 3 trigrams."""
    counts = np.zeros(_SYMBOLS**3, np.int64)
    sums = texts.mapInArrow(_trigram_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for gram, n in sums.collect():
        counts[gram] = n
    return LanguageModel.of(counts)


@released
def _count_batches(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    reader, seen = Reader(model), (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            seen[label.as_py()].update(reader.features(text.as_py() or ""))
    names = list(seen[1])  # a feature of the negative rows alone is of no use
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64())], names=["feature", "pos"])


@released
def _match_batches(batches: Iterator[pa.RecordBatch], model: LanguageModel, names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    reader = Reader(model, frozenset(names))
    for batch in batches:
        got = [sorted(names[x] for x in reader.features(t.as_py() or "")) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["label", "at"])


@dataclass(frozen=True)
class Classifier:
    language: LanguageModel
    names: dict
    weights: np.ndarray
    bias: float


def _fit_logistic(x: np.ndarray, negative: np.ndarray, positive: np.ndarray, penalty: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps, from how many rows of either label have each pattern of features (rows of x); the bias is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    n = negative + positive
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (n * p - positive) + ridge * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Classifier:
    """Fit on docs (doc_id, text), all of whose texts make the language model, and labels (doc_id, toxic).

    At most about TRAIN_ROWS labelled rows, drawn by the hash of doc_id, fit the
    classifier. Its features are the words and word beginnings of restored texts
    that tell the labels apart best on those rows.

    Null texts are empty. Labels with a null doc_id, or other than 0 and 1, take no
    part; of repeated ones of a doc_id the largest counts. Each row of docs with
    that doc_id is a labelled row, so repeated rows weigh more. Equally telling
    features go by name. Extra columns are ignored. Without labelled rows of both
    kinds, all texts get the one known label's score, or 0 about.
    """
    docs = spread(pick(docs, "doc_id", "text"))
    language = language_model(docs.select("text"))
    marks = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    n = marks.count()
    rows = docs.join(marks.where(unit < min(1.0, TRAIN_ROWS / max(1, n))), "doc_id").select("text", "toxic")
    rows = cut(rows, "labelled-texts").repartition(16)
    positive = rows.where("toxic = 1")
    tell = positive.mapInArrow(partial(_count_batches, model=language), "feature string, pos long").groupBy("feature").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= SUPPORT)
    common = {r[0]: i for i, r in enumerate(tell.orderBy(F.desc("pos"), "feature").limit(40 * FEATURES).collect())}
    total = np.array(rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first(), np.float64)
    if not common or not total.all():
        return Classifier(language, {}, np.zeros(0), 30.0 if total[1] and not total[0] else -30.0)

    def matched(names: dict[str, int]) -> DataFrame:
        return rows.mapInArrow(partial(_match_batches, model=language, names=names), "toxic int, at array<int>")

    seen = np.zeros((2, len(common)))
    for label, i, n in matched(common).select("toxic", F.explode("at").alias("i")).groupBy("toxic", "i").count().collect():
        seen[label, i] = n
    # the gain in likelihood from a feature that speaks for label 1
    rate = (seen + 0.5) / (total[:, None] + 1)
    gain = np.where(rate[1] > rate[0], seen[1] * np.log(rate[1] / rate[0]) + (total[1] - seen[1]) * np.log((1 - rate[1]) / (1 - rate[0])), 0)
    names = list(common)
    use = [i for i in np.lexsort((names, -gain))[:FEATURES] if gain[i] > 3 and rate[1][i] > 4 * rate[0][i]]
    wanted = {names[i]: k for k, i in enumerate(use)}
    # rows with the same features are one pattern with two counts; most rows have none
    counted = matched(wanted).groupBy("at").agg(F.count_if(F.col("toxic") == 0).alias("neg"), F.count_if(F.col("toxic") == 1).alias("pos"))
    patterns = sorted((tuple(r["at"]), r["neg"], r["pos"]) for r in counted.collect())
    x = np.zeros((len(patterns), len(use)))
    for r, (at, *_) in enumerate(patterns):
        x[r, list(at)] = 1
    both = np.array([p[1:] for p in patterns], np.float64).T
    w, b = _fit_logistic(x, both[0], both[1])
    return Classifier(language, wanted, w, b)


#: The reader of the scoring job that this worker process last worked for, by the job's key.
_readers: dict[str, Reader] = {}


@released
def _score_batches(batches: Iterator[pa.RecordBatch], model: Classifier, key: str) -> Iterator[pa.RecordBatch]:
    if key not in _readers:
        _readers.clear()
    weight = {x: float(model.weights[k]) for x, k in model.names.items()}
    reader = _readers.setdefault(key, Reader(model.language, frozenset(weight)))
    for batch in batches:
        scores = []
        for text in batch.column(1):
            z = model.bias + math.fsum(weight[x] for x in reader.features(text.as_py() or ""))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text.

    Null reads as empty, equal texts score alike, rows with a null or repeated
    doc_id are scored like others, extra columns are ignored, no rows give none.
    """
    return spread(pick(docs, "doc_id", "text")).mapInArrow(partial(_score_batches, model=model, key=uuid.uuid4().hex), "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
