"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the presence of words, of pairs of neighbouring words and of pairs with one word between
them, hashed into 2^20 coordinates. Training goes through a bounded sample of labelled texts (``TRAIN_ROWS``, and
``TRAIN_FEATURES`` in all) in one task, with a learning rate of each coordinate's own and an L1 term that leaves nearly
all weights at zero. Features are made where the texts lie, so that task holds whole numbers only. The few weights
that remain are collected, broadcast, and applied where each text is read; scoring shuffles nothing.

Defined cases: a null or empty text has the bias only, and so a score of its own; very long texts are read whole.
Without any labels the model is empty and every score is the same 0.5 of no evidence. Other columns pass through; a
column named like the output is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches
from leafmill.llm._labels import fold, labelled_texts
from leafmill.llm._tokens import CACHED_CHARS, CACHED_TOKENS, claim, keeps, release

#: Labelled rows that training sees at most, the features they may have in all (rows beyond are left out), and how often it sees each.
TRAIN_ROWS, TRAIN_FEATURES, EPOCHS = 12_000, 1 << 24, 3

#: Coordinates, and FTRL's learning rate, its smoothing, L1 and L2.
BITS, ALPHA, BETA, L1, L2 = 20, 0.3, 1.0, 6.0, 1.0

#: Contract: rows of fold 2 of 4 are held out; from 0.3 on a text counts as toxic.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

_WORD = re.compile(r"\w+")

#: Beside a word as it is, its first letters: inflected forms share a coordinate.
STEMS = (4, 6)

#: Words whose features are made at once.
TOGETHER = 1 << 16


def _hashes(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its stems, told apart by their length."""
    return (zlib.crc32(word.encode()), *(zlib.crc32(f"{n} {word[:n]}".encode()) for n in STEMS))


class _Rows:
    """Hashes of words: a table, and each word's row in it. Starts anew when it holds too many words or characters."""

    def __init__(self):
        self.clear()
        keeps(self.clear)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars, self.table = 0, np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > CACHED_TOKENS + TOGETHER or self.chars > CACHED_TOKENS * CACHED_CHARS:
            self.clear()
        at = self.at
        for word in set(words).difference(at):
            if len(self.table) == len(at):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(at)] = _hashes(word)
            at[word] = len(at)
            self.chars += len(word)
        return self.table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


_rows = _Rows()


class Model(NamedTuple):
    """Coordinates that have a weight, coordinate 0 being the bias."""

    at: np.ndarray
    weight: np.ndarray


def coordinates(text: str) -> np.ndarray:
    """Coordinates of a text's words, stems, pairs and skip pairs, repeats included; 0 is kept for the bias."""
    words = _WORD.findall(text.lower())
    # in parts that overlap by two words, so that no pair is lost
    parts = [_coordinates(words[at : at + TOGETHER + 2]) for at in range(0, max(1, len(words)), TOGETHER)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _coordinates(words: list[str]) -> np.ndarray:
    hashes = _rows(words)
    h = hashes[:, 0]
    near, far = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        parts = [hashes.ravel() * near]
        parts += [(h[:-k] * near + h[k:]) * mix for k, mix in ((1, far), (2, near ^ far)) if len(h) > k]
        x = np.concatenate(parts)
        x ^= x >> np.uint64(29)
        x = x * far
    return np.maximum((x >> np.uint64(64 - BITS)).astype(np.int32), 1)


def features(text: str) -> np.ndarray:
    """The text's coordinates, each once."""
    return np.unique(coordinates(text))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; weights are derived from z and n when needed."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1 * (at > 0), 0.0, -(z - np.sign(z) * L1 * (at > 0)) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> Model:
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return Model(at[w != 0].astype(np.int32), w[w != 0].astype(np.float32))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def train(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> Model:
    """``rows``: the features of each text."""
    rows = [np.concatenate([np.zeros(1, np.int32), r]) for r in rows]
    ftrl, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ftrl.learn(rows[i], labels[i])
    return ftrl.model()


def trained(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Trains in a worker that goes on to score: ``rows`` is emptied, and its memory goes back to the system."""
    model = train(rows, labels)
    rows.clear()
    release()
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Model:
    """Trains in one task on at most ``rows`` labelled texts, in the order of a hash of their ids; only weights that aren't zero come back."""
    bounded_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, "toxic", FOLDS, HELD_OUT, rows)

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        claim("toxicity")
        return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, n = [], [], 0
        for batch in batches:
            for data, label in zip(batch.column("made"), batch.column("label").to_pylist()):
                at = np.frombuffer(data.as_py(), np.int32)
                n += len(at)
                if n <= most_features:
                    held.append(at)
                    marks.append(label)
        model = trained(held, marks)
        yield pa.RecordBatch.from_arrays([pa.array(model.at), pa.array(model.weight)], names=["at", "weight"])

    ready = sample.select("doc_id", "label", made("text").alias("made")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = ready.select("made", "label").mapInArrow(run, "at int, weight float").toPandas()
    return Model(got["at"].to_numpy(np.int32), got["weight"].to_numpy(np.float32))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[model.at] = model.weight

    def __call__(self, text: str | None) -> float:
        at = coordinates(text or "")
        held = np.unique(at[self.dense[at] != 0])
        return sigmoid(float(self.dense[0]) + float(self.dense[held].sum(dtype=np.float64)))


_scorer: list[Scorer] = []
keeps(_scorer.clear)


def scorer_of(model: Model) -> Scorer:
    """The scorer of this very model: it holds the model, so another one can't be taken for it."""
    if not _scorer or _scorer[0].model is not model:
        _scorer[:] = [Scorer(model)]
    return _scorer[0]


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: how likely the whole text is toxic."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def likely(texts: pa.Array) -> pa.Array:
        claim("toxicity")
        scorer = scorer_of(sent.value)
        return pa.array((scorer(t.as_py()) for t in texts), pa.float64(), size=len(texts))

    return df.withColumn(out, likely(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
