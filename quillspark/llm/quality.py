"""Quality classifier: supervised subword embeddings.

A document's vector is the average of the learned vectors of its words, pairs of
neighbouring words and character n-grams, all hashed into one table of buckets and each
kind with the same weight; a softmax over a linear layer gives the classes. Trained by stochastic gradient descent
in numpy: shards of the training rows run it side by side from the same start, and the
average of what they reach is the next start.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, materialize, slices, table
from ._words import batch_words, mix
from .toxicity import fit_curve

#: Most labelled rows that training reads, those of the least hash of doc_id.
TRAIN_ROWS = 8_000
#: Training rows are dealt into so many shards, whatever the number of executors.
SHARDS = 8
#: Averages of the shards, and passes over a shard before each.
ROUNDS, PASSES = 4, 3
#: log2 of the buckets, length of a vector, and lengths of the character n-grams.
BITS, WIDTH, GRAMS = 16, 8, (3, 4, 5)
RATE = 0.5
ACCEPT = 0.3

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_WHITE = np.array([9, 10, 11, 12, 13], np.uint32)


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * _FACTOR >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: pa.Array, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of whole texts by kind; each with the places where the texts' own begin, and the end.

    Kinds are words, pairs of words, and the n-grams of each length.
    Words are runs other than space and 0x09-0x0D. A pair of words is hashed by the
    difference of its words' hashes, so any word said twice falls in one bucket.
    Character n-grams lie inside a word or take in the space at its ends. Null is empty.
    """
    found = batch_words(texts)
    yield _buckets(found.hashes, bits), found.first
    same = found.doc[1:] == found.doc[:-1]
    yield _buckets(mix(found.hashes[1:] - found.hashes[:-1])[same], bits), np.r_[0, np.cumsum(same)][np.maximum(found.first - 1, 0)] if len(same) else np.zeros_like(found.first)

    said = [f" {t} " if t else "" for t in texts.to_pylist()]
    starts = np.cumsum([0, *map(len, said)])
    code = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)
    code = np.where(np.isin(code, _WHITE), np.uint32(32), code)
    spaces = np.r_[0, np.cumsum(code == 32)]
    rolling = code.astype(np.uint64)
    for n in range(2, max(grams, default=1) + 1):
        rolling = rolling[:-1] * _BASE + code[n - 1 :] if len(rolling) > 1 else rolling[:0]
        if n in grams:
            inside = spaces[n - 1 : len(code)] == spaces[1 : len(code) - n + 2] if len(rolling) else np.zeros(0, bool)
            yield _buckets(mix(rolling[inside] + np.uint64(n)), bits), np.r_[0, np.cumsum(inside)][np.minimum(starts, len(inside))]


@dataclass
class Model:
    """Vectors of the buckets, the layer over them (two classes) and its bias; with the sums of squared steps that training goes on from."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    layer_seen: np.ndarray

    @staticmethod
    def start(bits: int = BITS, width: int = WIDTH, seed: int = 1) -> Model:
        vectors = np.random.default_rng(seed).uniform(-1 / width, 1 / width, (1 << bits, width))
        return Model(vectors.astype(np.float32), np.zeros((2, width), np.float32), np.zeros(2, np.float32), np.full(1 << bits, 1e-8, np.float32), np.full((2, width + 1), 1e-8, np.float32))

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.vectors, self.layer, self.bias, self.seen, self.layer_seen)]

    def average(self, others: list[list[bytes]]) -> Model:
        """The mean of models in the form of parts(), summed in the order given."""
        mine = (self.vectors, self.layer, self.bias, self.seen, self.layer_seen)
        return Model(*(np.mean([np.frombuffer(o[k], np.float32).reshape(x.shape) for o in others], axis=0, dtype=np.float64).astype(np.float32) for k, x in enumerate(mine)))

    def learn(self, bucket: np.ndarray, weight: np.ndarray, y: int, rate: float = RATE) -> None:
        """One step of gradient descent on a document: its buckets, each once, with their shares; steps shrink with the squares of those before."""
        rows = self.vectors[bucket]
        hidden = weight @ rows
        p = softmax(self.layer @ hidden + self.bias)
        p[y] -= 1.0
        back = p @ self.layer
        slope = np.column_stack([np.outer(p, hidden), p])
        self.layer_seen += slope * slope
        step = rate * slope / np.sqrt(self.layer_seen)
        self.layer -= step[:, :-1]
        self.bias -= step[:, -1]
        self.seen[bucket] += weight * weight * (back @ back / len(back))
        self.vectors[bucket] = rows - (rate * weight / np.sqrt(self.seen[bucket]))[:, None] * back

    def margins(self) -> np.ndarray:
        """What each bucket adds to class 1 over class 0: averaging is linear, so the layer may come before it."""
        return self.vectors.astype(np.float64) @ (self.layer[1] - self.layer[0]).astype(np.float64)

    def scorer(self, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
        """A function of an Arrow array of texts: the margin of class 1 over class 0 of each."""
        margins, bias = self.margins(), float(self.bias[1] - self.bias[0])

        def measure(texts: pa.Array) -> np.ndarray:
            kinds = []
            for bucket, first in features(texts, bits, grams):
                sums = np.r_[0.0, np.cumsum(margins[bucket])]
                kinds.append((sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1))
            return bias + np.mean(kinds, axis=0)

        return measure

    def stretched(self, shift: float, slope: float) -> Model:
        """The model whose margins are shift + slope * margin."""
        bias = np.float32([0, shift + slope * float(self.bias[1] - self.bias[0])])
        return Model(self.vectors, np.float32(slope) * self.layer, bias, self.seen, self.layer_seen)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def counted(text: str | None, bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text, each once, and their shares: every kind of features has the same weight as a whole."""
    kinds = [b for b, _ in features(pa.array([text], pa.string()), bits, grams)]
    bucket, at = np.unique(np.concatenate(kinds), return_inverse=True)
    share = np.concatenate([np.full(len(b), 1 / max(1, len(b)) / len(kinds)) for b in kinds])
    return bucket, np.bincount(at, share, len(bucket)).astype(np.float32)


def train_shard(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int, seed: int) -> Model:
    """Passes over rows (buckets, shares, class), each in another order. Changes the model."""
    for k in range(passes):
        for i in np.random.default_rng([seed, k]).permutation(len(rows)):
            bucket, weight, y = rows[i]
            if len(bucket):
                model.learn(bucket, weight, y)
    return model


def held_out(id_col: str):
    """Whether a document is held out of training: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, shards: int = SHARDS) -> DataFrame:
    """(shard, doc_id, text, y): the labelled rows to learn from, at most train_rows, never held-out ones.

    Rows with a null id or label, and labels other than 0 and 1, are left out; of an id with
    both labels the larger holds, and of an id with several texts the least.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "train_ids")
    found = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most train_rows ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).alias("shard"), "doc_id", "text", "y")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, shards: int = SHARDS, rounds: int = ROUNDS, passes: int = PASSES, bits: int = BITS, width: int = WIDTH, grams: tuple[int, ...] = GRAMS) -> Model:
    """A model of training_rows(). Without rows of both classes it scores every text 0.5.

    The first shard is not trained on: a logistic curve over its margins sets the scale of
    the scores, which those of the trained rows would put too far apart.

    A task holds one shard, train_rows / shards documents or about so many; the driver
    holds the shards' models, whose size is fixed by bits and width. Shards, their
    orders and the order of sums do not depend on the cluster.
    """
    rows = materialize(training_rows(docs, labels, label, id_col, text_col, train_rows, shards), "train")
    model = Model.start(bits, width)
    sizes = {(r["aside"], r["y"]) for r in rows.select((F.col("shard") == 0).alias("aside"), "y").distinct().collect()}
    if not {(False, 0), (False, 1)} <= sizes:
        return model
    for k in range(rounds):
        task = _shard_task(rows.sparkSession.sparkContext.broadcast(model), passes, rounds, k, bits, grams)
        reached = sorted(rows.where("shard > 0").groupBy("shard").applyInArrow(task, _REACHED).collect(), key=lambda r: r["shard"])  # one row for each shard
        model = model.average([list(r[1:]) for r in reached])
    if not {(True, 0), (True, 1)} <= sizes:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        margin = shared.value.scorer(bits, grams)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([pa.array(margin(b.column(0))), b.column(1)], ["z", "y"])

    aside = np.array(rows.where("shard = 0").select("text", "y").mapInArrow(measure, "z double, y int").collect(), float).reshape(-1, 2)
    aside = aside[np.lexsort(aside.T)]
    return model.stretched(*fit_curve(aside[:, :1], aside[:, 1]))


_REACHED = "shard long, vectors binary, layer binary, bias binary, seen binary, layer_seen binary"


def _shard_task(begin, passes: int, rounds: int, k: int, bits: int, grams: tuple[int, ...]):
    """What a task does with one shard in round k: train from the broadcast model, give the parts of what it reaches."""

    def run(key, part):  # without hints: Spark would take them for another kind of function
        part = part.sort_by("doc_id")
        rows = [(*counted(t, bits, grams), y) for t, y in zip(part["text"].to_pylist(), part["y"].to_pylist(), strict=True)]
        model, shard = copy.deepcopy(begin.value), key[0].as_py()
        train_shard(model, rows, passes, shard * rounds + k)
        return pa.table([pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in model.parts())], names=[c.split()[0] for c in _REACHED.split(", ")])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Null, empty and white texts have no features and get the softmax of the bias alone.
    A null id is never held out. Repeated rows give repeated rows; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        margin = shared.value.scorer(bits, grams)
        for whole in batches:
            for b in slices(whole):
                z = np.clip(margin(b.column(1)), -40, 40)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scored = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op13_quality(spark, sf_dir):
    """Scores of all documents by a model of the labels; odd rows as in score()."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
