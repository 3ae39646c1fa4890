"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes homoglyphs and digit substitutions and turns what is not a letter
into spaces. The lexicon has words and word beginnings; its weights are log odds
learned from labelled documents. A match inside an exception phrase does not
count. A logistic curve over the matched weight, as a whole and for the length
of the text, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held, keyed, materialize, slices, table

#: Most labelled rows that training reads, those of the least hash of doc_id.
TRAIN_ROWS = 20_000
#: A candidate is in so many toxic training documents at least, and has this weight at least.
SUPPORT, LEAST_WEIGHT = 4, 2.0
#: Word beginnings of these lengths are candidates.
SHORTEST, LONGEST = 3, 12
REJECT = 0.7

# Seed words, exception phrases, and what stands for which letter.
SEEDS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
SEED_WEIGHT = 4.0
EXCEPTIONS = "clown fish,class clown,circus clown,trash can,trash bin,trash bag,trash collection,sore loser,pond scum,scum line".split(",")
HOMOGLYPHS = {
    "a": "аαɑ@4", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еεё3", "g": "ɡ", "h": "һ", "i": "іιıl1|ӏ", "j": "ј", "k": "кκ",
    "m": "м", "n": "п", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ$5", "t": "тτ7", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ",
}
INVISIBLE = "­​‌‍⁠﻿"


#: Accents, strokes and other marks laid over letters.
MARKS = {code: None for code in range(0x300, 0x370)}
#: Longer runs of letters and marks than this are not looked at: no seed word has as many marks.
LONGEST_MARKED = 64
STROKES = str.maketrans("ƀđħɨłøŧ", "bdhilot")
#: A "!" before one of these may stand for i; at the end of a word it is a stop.
_SHOUT = re.compile(r"!(?=[^\W_])")


class _Fold(dict):
    """For str.translate: what stands for a letter becomes it; other characters that are not letters, a space."""

    def __missing__(self, code: int):
        c = chr(code)
        out = c if c.isalpha() or unicodedata.combining(c) else " "
        self[code] = out
        return out


_FOLD = _Fold({ord(c): letter for letter, alike in HOMOGLYPHS.items() for c in alike})
_FOLD.update({ord(c): None for c in INVISIBLE})
_KNOWN = frozenset(w.translate(_FOLD) for w in SEEDS)


@lru_cache(1 << 16)
def _unmarked(word: str) -> str:
    """A seed word without the marks that hide it. Other words keep theirs, which tell words of many languages apart."""
    bare = unicodedata.normalize("NFD", word).translate(MARKS).translate(STROKES).translate(_FOLD)
    return bare if bare in _KNOWN else word


def fold(text: str | None) -> str:
    """Folded text between spaces; l and i become the same letter, for 1 stands for both, and "!" inside or before a word is i."""
    if not text:
        return " "
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "!" in text:
        text = _SHOUT.sub("i", text)
    text = text.lower().translate(_FOLD)
    if not text.isascii():
        text = " ".join(w if w.isascii() or len(w) > LONGEST_MARKED else _unmarked(w) for w in text.split(" "))
    return f" {text} "


@dataclass
class Model:
    """Lexicon and curve. Entries start with a space; one that ends with a space is a whole word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-5.0, 1.0, 0.5, 0.5)

    def machine(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0))
        out.make_automaton()
        return out


def matched(machine: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in folded text outside exception phrases; of nested entries the heaviest."""
    if not len(machine):
        return []
    hits, spared = {}, []
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight == 0.0:
            spared.append((start, end))
        elif weight > hits.get(start, (0, 0.0))[1]:
            hits[start] = (end, weight)
    if spared:
        spared.sort()
        begins = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))  # how far the phrases up to here go
        hits = {s: (e, w) for s, (e, w) in hits.items() if not (k := bisect_right(begins, s)) or e > reach[k - 1] + 1}
    return [(s, e, w) for s, (e, w) in hits.items()]


def features(machine: ahocorasick.Automaton, folded: str) -> tuple[float, float, float]:
    """Matched weight, the same for 100 words, and the largest weight, on log scales."""
    found = [w for _, _, w in matched(machine, folded)]
    total, words = sum(found), folded.count(" ")
    return math.log1p(total), math.log1p(100 * total / (words + 10)), max(found, default=0.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_curve(rows: np.ndarray, toxic: np.ndarray, l2: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; no weight may turn negative, so more matches never lower a score."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w, active = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(60):
        p = _sigmoid(x @ w)
        ridge = l2 * len(x) * np.r_[0.0, np.ones(x.shape[1] - 1)]
        gradient = x.T @ (p - toxic) + ridge * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.zeros_like(w)
        step[active] = np.linalg.solve(hessian[np.ix_(active, active)], gradient[active])
        w -= step
        negative = (w < 0) & (np.arange(len(w)) > 0)
        active &= ~negative
        w[negative] = 0
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _candidates(folded: str) -> set[str]:
    """Words (with a space after) and word beginnings."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= SHORTEST:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def _counted(train: DataFrame, of, least: int = 1) -> DataFrame:
    """(feature, toxic, clean): in how many training documents each feature of of(folded) is."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "folded"):
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for folded, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    counts[y].update(of(folded))
                names = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], ["feature", "toxic", "clean"])

    rows = train.mapInArrow(run, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= least)


def _lexicon(toxic: dict[str, int], clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Of the candidates, those that say most: a beginning gives way to a longer one that is in nearly the same documents."""
    weight = {f: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1)) for f, t in toxic.items()}
    longest: dict[str, int] = {}
    for f, t in toxic.items():
        parent = f[:-1]
        longest[parent] = max(longest.get(parent, 0), t)
    kept: dict[str, float] = {}
    for f in sorted(toxic, key=lambda f: (len(f), f)):
        if weight[f] < LEAST_WEIGHT or longest.get(f, 0) >= 0.95 * toxic[f]:
            continue
        above = max((kept[f[:k]] for k in range(1 + SHORTEST, len(f)) if f[:k] in kept), default=-math.inf)
        if weight[f] > above + 0.7:
            kept[f] = weight[f]
    return {f: round(w, 4) for f, w in kept.items()}


def _contexts(machine: ahocorasick.Automaton):
    """The matched words of a text, and each with the word before or after it."""

    def of(folded: str) -> set[str]:
        out = set()
        for start, _, _ in matched(machine, folded):
            end = folded.find(" ", start + 1)  # a folded text ends with a space
            word = folded[start + 1 : end]
            before = folded[folded.rfind(" ", 0, start) + 1 : start]
            after = folded[end + 1 : max(end + 1, folded.find(" ", end + 1))]
            out.add(f" {word} ")
            if before:
                out.add(f" {before} {word} ")
            if after:
                out.add(f" {word} {after} ")
        return out

    return of


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labels (doc_id, toxic), never from held-out ids (see held_out).

    Rows with a null id or label are left out. At most train_rows labels are
    used, those whose ids have the least hash. Without any toxic or any clean
    row the model is the seed words with a fixed curve.
    """
    seeds = {f"{fold(w).rstrip()} ": SEED_WEIGHT for w in SEEDS}
    spared = [fold(p) for p in EXCEPTIONS]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = materialize(chosen, "train_ids")

    def folds(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(t) for t in b.column(1).to_pylist()], pa.string()), b.column(2)], ["doc_id", "folded", "toxic"])

    train = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    train = materialize(train.mapInArrow(folds, "doc_id long, folded string, toxic int"), "train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(seeds, spared)

    # candidates come from the training rows alone, so train_rows bounds what reaches the driver
    toxic = {r["feature"]: r["toxic"] for r in _counted(train.where("toxic = 1"), _candidates, SUPPORT).select("feature", "toxic").collect()}
    names = train.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = Counter({r["feature"]: r["clean"] for r in _counted(train.where("toxic = 0"), lambda t: _candidates(t) & names.value).collect()})
    weights = seeds | _lexicon(toxic, clean, sizes[1], sizes[0])

    model = Model(weights, spared)
    contexts = _counted(train, lambda t: _contexts(_machine(model))(t), 2).where("clean >= 2").where(F.col("clean") * sizes[1] >= F.col("toxic") * sizes[0])
    contexts = contexts.orderBy("feature").select("feature")
    model = Model(weights, spared + [r["feature"] for r in contexts.collect() if r["feature"] not in weights])

    def measure(batches):
        machine = model.machine()
        for b in batches:
            rows = np.array([features(machine, t) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), b.column(2)], ["a", "b", "c", "toxic"])

    rows = np.array(train.mapInArrow(measure, "a double, b double, c double, toxic int").collect(), float).reshape(-1, 4)
    rows = rows[np.lexsort(rows.T)]
    return Model(model.weights, model.exceptions, fit_curve(rows[:, :3], rows[:, 3]))


def _machine(model: Model) -> ahocorasick.Automaton:
    """The model's automaton in this worker, compiled once."""
    return held(("toxicity", tuple(model.weights.items()), tuple(model.exceptions)), model.machine)


def held_out(id_col: str):
    """Whether a document is held out of training: crc32(doc_id as text) mod 3 = 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Null and empty texts match nothing and get the curve's lowest score. A null
    id is never held out. Repeated rows give repeated rows.
    """

    def run(batches):
        machine = _machine(model)
        for whole in batches:
            for b in slices(whole):
                folded = [fold(t) for t in b.column(1).to_pylist()]
                rows = np.array([features(machine, t) for t in folded]).reshape(-1, 3)
                p = _sigmoid(model.curve[0] + rows @ np.array(model.curve[1:]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    scored = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below reject."""
    columns = docs.schema
    at = columns.names.index(text_col)

    def run(batches):
        machine = _machine(model)
        curve = np.array(model.curve[1:])
        for whole in batches:
            for b in slices(whole, text_col):
                rows = np.array([features(machine, fold(t)) for t in b.column(at).to_pylist()]).reshape(-1, 3)
                yield b.filter(pa.array(_sigmoid(model.curve[0] + rows @ curve) < reject))

    return docs.mapInArrow(run, columns)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
