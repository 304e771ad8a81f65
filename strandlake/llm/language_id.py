"""Language ID: the family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._memory import released
from strandlake.llm._store import cut, drop, pick, spread
from strandlake.llm._text import LOWER, slices

#: Hashed byte trigrams that a text is described by.
DIMS = 2048
#: About the labelled rows in all that the machines are fitted on, which languages share evenly, and the rows that each may have however many languages there are.
ROWS, LEAST = 4800, 75
#: Families of language codes (fixed values); any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
}
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


@dataclass(frozen=True)
class Model:
    """langs and families, and one row of weights (DIMS and a bias) for each pair: families first, then the languages of each family."""

    langs: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the share of sure wins on the way, between 0 and 1."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        at = {p: i for i, p in enumerate(self.pairs)}
        tree: dict[str, list[str]] = {}
        for lang in self.langs:
            tree.setdefault(family_of(lang), []).append(lang)

        def vote(rows: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """For each row the name that wins the most duels, of equal ones the surest, and its least sure duel."""
            duels = list(combinations(range(len(names)), 2))
            i, j = np.array(duels, np.int64).reshape(-1, 2).T
            p = 1 / (1 + np.exp(-np.clip(4 * margin[np.ix_(rows, [at[names[a], names[b]] for a, b in duels])], -30, 30)))
            votes, sure = np.zeros((len(names), len(rows))), np.ones((len(names), len(rows)))
            np.add.at(votes, i, (p > 0.5).T)
            np.add.at(votes, j, (p <= 0.5).T)
            np.minimum.at(sure, i, p.T)
            np.minimum.at(sure, j, 1 - p.T)
            best = np.argmax(votes + sure / 2, axis=0)
            return best, sure[best, np.arange(len(rows))]

        names = sorted(tree)
        top, score = vote(np.arange(len(x)), ["/" + f for f in names])
        out = np.empty(len(x), object)
        for i, f in enumerate(names):
            rows = np.flatnonzero(top == i)
            best, sure = vote(rows, tree[f])
            out[rows] = np.array(tree[f], object)[best]
            score[rows] *= sure
        return list(out), score


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Root-scaled, length-normalised counts of hashed byte trigrams of whole documents; what is no letter reads as one space."""
    low = np.where(_LETTER[data], LOWER[data], 32).astype(np.uint32)
    code = np.zeros(len(low), np.int64)
    if len(low) > 2:
        code[:-2] = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    x = np.zeros((len(offsets) - 1, DIMS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a > 2:
            x[i] = np.bincount(code[a : b - 2], minlength=DIMS)
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps; the two classes weigh alike. All in single precision, so that no step copies x."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32, copy=False)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 / c + 2 * 2.0))
    for t in range(steps):
        z = w + np.float32(t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ z))
        last, w = w, z - rate * (z * np.float32(0.1 / c) - 2 * ((weight * slack * y) @ x))
    return w


def machine_pairs(langs: list[str]) -> list[tuple[str, str]]:
    """The pairs that have a machine: families, marked by a slash, then the languages of each family."""
    family = {lang: "/" + family_of(lang) for lang in langs}
    tops = sorted(set(family.values()))
    out = list(combinations(tops, 2))
    for f in tops:
        out += combinations(sorted(lang for lang in langs if family[lang] == f), 2)
    return out


def _sides(langs: list[str]) -> list[tuple[str, str, int, int, int]]:
    """(lang, its name in a group of names, group, tile, tile): the tasks that a language's rows take part in.

    A group's names are cut into at most about eight tiles; a task fits the pairs
    between two tiles, so rows are copied a bounded number of times, however many
    languages there are.
    """
    family = {lang: "/" + family_of(lang) for lang in langs}
    tops = sorted(set(family.values()))
    groups = [(tops, family)] + [([x for x in sorted(langs) if family[x] == f], None) for f in tops]
    out = []
    for g, (names, of) in enumerate(groups):
        wide = max(1, len(names) // 8)
        tile = {name: i // wide for i, name in enumerate(names)}
        for lang in langs:
            name = of[lang] if of else lang
            if len(names) > 1 and name in tile:
                out += [(lang, name, g, min(tile[name], t), max(tile[name], t)) for t in range(-(-len(names) // wide))]
    return out


def _fit_tiles(task: pd.DataFrame, wide: dict[int, int], places: dict[str, int]) -> pd.DataFrame:
    """The machines of the pairs of names between a task's two tiles."""
    # the order that rows arrive in must not move sums
    task = task.sort_values(["name", "x"], kind="stable")
    name, x = task["name"].to_numpy(), np.frombuffer(b"".join(task["x"]), np.float32).reshape(-1, DIMS)
    g, first, second = (int(task[c].iloc[0]) for c in ("g", "first", "second"))
    out = []
    for a, b in combinations(sorted(set(name)), 2):
        if {places[a] // wide[g], places[b] // wide[g]} == {first, second}:
            rows = np.flatnonzero((name == a) | (name == b))
            out.append((a, b, fit_machine(x[rows], np.where(name[rows] == a, 1.0, -1.0)).tobytes()))
    return pd.DataFrame(out, columns=["a", "b", "w"])


@released
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame, seed: int = 7) -> Model:
    """Fit on rows (doc_id, text, lang) with lang not null: about ROWS in all, as many of each language but up to LEAST at least, drawn by the hash of doc_id. Every language is learned.

    The drawn rows' features are written to the shared folder; the machines are
    fitted in tasks of bounded size, each on the rows of the names that it tells
    apart.

    Null texts and null languages take no part; empty texts do, as rows without
    features.  Rows that repeat a doc_id are drawn together, those of a null doc_id
    like any other value's, and count as often as they occur.  Of rows with equal
    hashes and doc_ids beyond a language's share, any may be left out.  Extra
    columns are ignored.  Without rows the model knows no language.
    """
    rows = pick(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    sizes = [tuple(r) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not sizes:
        return Model((), (), np.zeros((0, DIMS + 1)))
    # half as many again as wanted pass the hash, then a window over that bounded rest takes the wanted number
    share = max(LEAST, ROWS // len(sizes))
    # a look-up, since one condition for each language would nest too deep
    limit = F.element_at(F.create_map(*[F.lit(v) for lang, n in sizes for v in (lang, min(1.0, (1.5 * share + 50) / n))]), F.col("lang"))
    unit = F.pmod("h", F.lit(1 << 32)) / float(1 << 32)
    some = rows.where(unit < limit).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= share)
    langs = sorted(lang for lang, _ in sizes)
    sides = _sides(langs)
    pairs = machine_pairs(langs)
    weights = np.zeros((len(pairs), DIMS + 1), np.float32)
    if sides:
        table = cut(some.select("lang", "text").mapInArrow(_feature_batches, "lang string, x binary"), "language-features")
        places, wide = {}, {}
        for _, name, g, *_ in sides:
            places.setdefault((g, name), None)
        for g in {g for g, _ in places}:
            names = sorted(name for h, name in places if h == g)
            wide[g] = max(1, len(names) // 8)
            places |= {(g, name): i for i, name in enumerate(names)}
        # about eight rows for each language: as small as the list of languages; from Arrow, since rows of Python objects would start workers of another kind, which stay
        fields = pa.schema([("lang", pa.string()), ("name", pa.string()), ("g", pa.int32()), ("first", pa.int32()), ("second", pa.int32())])
        tasks = labelled.sparkSession.createDataFrame(pa.table(list(zip(*sides)), schema=fields))
        made = table.join(F.broadcast(tasks), "lang").groupBy("g", "first", "second").applyInPandas(partial(_fit_tiles, wide=wide, places={name: i for (_, name), i in places.items()}), "a string, b string, w binary")
        at = {p: i for i, p in enumerate(pairs)}
        for a, b, w in made.collect():
            weights[at[a, b]] = np.frombuffer(w, np.float32)
        drop(table)
    return Model(tuple(langs), tuple(pairs), weights)


def _letterless(text: bytes) -> bool:
    return not any(c.isalpha() for c in text.decode("utf-8", "replace"))


@released
def _predict_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    ascii_letter = _LETTER.copy()
    ascii_letter[128:] = False
    for batch in batches:
        for row, data, offsets in slices(batch.column(at)):
            n = len(offsets) - 1
            seen = np.r_[0, np.cumsum(ascii_letter[data])]
            none = seen[offsets[1:]] == seen[offsets[:-1]]
            for i in np.flatnonzero(none):
                none[i] = _letterless(data[offsets[i] : offsets[i + 1]].tobytes())
            langs, scores = [], []
            for begin in range(0, n, 256):
                end = min(n, begin + 256)
                if model.langs:
                    a, b = model.predict(features(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]))
                else:
                    a, b = [UNKNOWN] * (end - begin), np.zeros(end - begin)
                langs += a
                scores += list(b)
            langs = [UNKNOWN if x else v for x, v in zip(none, langs)]
            scores = np.where(none, 0.0, scores)
            names = [*batch.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*[c.slice(row, n) for c in batch.columns], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs and lang_pred, score (0 to 1) for each row's whole text.

    Null texts and texts without a letter are ``und`` with score 0. A model of no
    languages predicts ``und``. One language is predicted with score 1. Equal
    texts get equal predictions; repeated rows and null doc_ids are rows like any
    other. Columns of docs that are named like another but for letter case, or
    lang_pred or score, give way. No rows give none.
    """
    names: dict[str, str] = {"lang_pred": "", "score": ""}
    for name in docs.columns:
        names.setdefault(name.lower(), name)
    docs = spread(pick(docs, *[n for n in names.values() if n]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(partial(_predict_batches, model=model, at=docs.columns.index(text)), f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language, by machines fitted on the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pick(docs, "doc_id", "text", "lang")
    model = fit(rows.where(~held_out()))
    return predict(rows.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
