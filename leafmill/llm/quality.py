"""Quality: random-indexing word vectors pooled for each document, then a two-layer network with calibrated output.

Tokens are words and runs of marks, as written. Spark counts them over all documents; the ``WORDS`` most frequent ones have an
entry of their own, all rarer ones share ``SHARED`` more by a hash, and one stands for any token just repeated. Each
entry has a fixed sparse random index vector, and its word vector is the sum of its neighbours' index vectors over all
documents: tasks add up tables of whole numbers and of a fixed size, which go, part by part and compressed, to tasks that sum
and normalise them. A document is the mean of its tokens' unit vectors. The network is trained with numpy on a bounded
sample of labelled documents (``TRAIN_ROWS``), a part of which is kept to fit the temperature that divides its logits.
Words, vectors and network have a fixed size, are broadcast, and are applied where each text is read.

Defined cases: a null or empty text pools to the zero vector, and so has the score the network gives to that; very
long texts are read whole. Without any labels every score is 0.5. Other columns pass through; a column named like the
output is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches
from leafmill.llm._labels import fold, labelled_texts
from leafmill.llm._tokens import CACHED_CHARS, claim, keeps

#: Labelled rows that training sees at most; words with an entry of their own, entries that the others share, the entry of repeated tokens being one more.
TRAIN_ROWS, WORDS, SHARED = 20_000, 1 << 15, (1 << 12) - 1
ENTRIES = 1 + WORDS + SHARED

#: Dimensions, places of an index vector that aren't zero, and neighbours on each side.
DIMENSIONS, PLACES, REACH = 128, 4, 2

#: Hidden units, epochs, rows of a step, learning rate, weight decay, and the share of rows kept for the temperature.
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY, KEPT = 32, 40, 256, 0.003, 1e-4, 0.2

#: Contract: rows of fold 0 of 5 are held out; under 0.3 a text counts as poor.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

#: Parts of the table that are summed apart, tokens whose contexts are added together, and different tokens that a task counts before it sends them.
PARTS, TOGETHER, COUNTED = 512, 1 << 18, 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The entry of a token that stands one or two tokens before already, whatever it is.
AGAIN = 0


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


class Entries(dict):
    """The entry of each token; rare and long ones are hashed each time they are seen."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(AGAIN + 1, AGAIN + 1 + len(words))))
        self.words = words

    def __missing__(self, token: str) -> int:
        return AGAIN + 1 + WORDS + zlib.crc32(token.encode()) % SHARED

    def of(self, text: str) -> np.ndarray:
        """Entries of a text's tokens."""
        found = _TOKEN.findall(text)
        ids = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        again = np.zeros(len(ids), bool)
        for k in (1, 2):
            again[k:] |= ids[k:] == ids[:-k]
        ids[again] = AGAIN
        return ids


_entries: list[Entries] = []
keeps(_entries.clear)


def entries_of(words: list[str]) -> Entries:
    """The look-up of this very list of words."""
    claim("quality")
    if not _entries or _entries[0].words is not words:
        _entries[:] = [Entries(words)]
    return _entries[0]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each entry's index vector, the same on every machine."""
    random = np.random.Generator(np.random.PCG64(20))
    return random.integers(0, DIMENSIONS, (ENTRIES, PLACES), np.int32), random.choice(np.array([-1, 1], np.int32), (ENTRIES, PLACES))


def add_contexts(table: np.ndarray, tokens: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to each token's entry its neighbours' index vectors; -1 ends a document."""
    places, signs = vectors
    for k in range(1, REACH + 1):
        a, b = tokens[:-k], tokens[k:]
        both = (a >= 0) & (b >= 0)
        for j in range(1, k):
            both &= tokens[j : len(tokens) - k + j] >= 0
        a, b = a[both], b[both]
        for at, other in ((a, b), (b, a)):
            row = at * DIMENSIONS
            for p in range(PLACES):
                np.add.at(table, row + places[other, p], signs[other, p])


def frequent_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The ``WORDS`` tokens that are most frequent in all documents, of up to ``CACHED_CHARS`` characters; ties by code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            kept = [t for t in seen if len(t) <= CACHED_CHARS]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[t] for t in kept], pa.int64())], names=["token", "n"])

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    seen.update(_TOKEN.findall(t.as_py()))
                    if len(seen) >= COUNTED:
                        yield out()
                        seen.clear()
        yield out()

    counts = docs.select(F.col(text)).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # at most WORDS short strings, whatever the input
    return [r.token for r in counts.orderBy(F.desc("n"), "token").limit(WORDS).collect()]


def word_vectors(docs: DataFrame, words: list[str], text: str = "text") -> np.ndarray:
    """Unit word vectors of all entries, from all documents: ENTRIES x DIMENSIONS numbers on the driver, whatever the input."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, vectors = entries_of(sent.value), index_vectors()
        table, held, n, end = np.zeros(ENTRIES * DIMENSIONS, np.int32), [], 0, np.array([-1], np.int32)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    held += [entries.of(t.as_py()), end]
                    n += len(held[-2])
                    if n >= TOGETHER:
                        add_contexts(table, np.concatenate(held), vectors)
                        held, n = [], 0
        if held:
            add_contexts(table, np.concatenate(held), vectors)
        for at in range(0, PARTS, 32):
            parts = range(at, min(at + 32, PARTS))
            sums = [zlib.compress(np.ascontiguousarray(table.reshape(ENTRIES, DIMENSIONS)[p::PARTS]), 1) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sums, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole numbers: their sums don't depend on the order."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(zlib.decompress(data.as_py()), np.int32).reshape(-1, DIMENSIONS)
                if part in sums:
                    sums[part] += values
                else:
                    sums[part] = values.astype(np.int64)
        units = [(s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)).astype(np.float32) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([u.tobytes() for u in units], pa.binary())], names=["part", "sums"])

    kind = "part int, sums binary"
    got = docs.select(F.col(text)).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toArrow()
    table = np.zeros((ENTRIES, DIMENSIONS), np.float32)
    for part, data in zip(got.column("part").to_pylist(), got.column("sums")):
        table[part::PARTS] = np.frombuffer(data.as_py(), np.float32).reshape(-1, DIMENSIONS)
    return table


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean of the entries' vectors."""
    if not len(ids):
        return np.zeros(DIMENSIONS, np.float32)
    if len(ids) > ENTRIES // 16:  # long texts by their counts, so that memory doesn't grow with them
        return np.bincount(ids, minlength=ENTRIES).astype(np.float32) @ vectors / len(ids)
    return vectors[ids].sum(axis=0) / len(ids)


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.maximum((x - net.mean) / net.scale @ net.w1 + net.b1, 0) @ net.w2 + net.b2


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_logits(net, x) / net.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on the cross-entropy of a network with one hidden layer, then the temperature on rows that were kept."""
    random = np.random.Generator(np.random.PCG64(seed))
    order = random.permutation(len(y))
    kept, rows = np.split(order, [int(KEPT * len(y))])
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    shapes = ((DIMENSIONS, HIDDEN), (HIDDEN,), (HIDDEN,), ())
    params = [random.normal(0, (2 / DIMENSIONS) ** 0.5, shapes[0]), np.zeros(shapes[1]), random.normal(0, (1 / HIDDEN) ** 0.5, shapes[2]), np.zeros(())]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    z, step = (x - mean) / scale, 0
    for _ in range(EPOCHS):
        random.shuffle(rows)
        for at in range(0, len(rows), STEP_ROWS):
            part, step = rows[at : at + STEP_ROWS], step + 1
            w1, b1, w2, b2 = params
            hidden = np.maximum(z[part] @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40))) - y[part]) / len(part)
            back = np.outer(error, w2) * (hidden > 0)
            grads = [z[part].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum()]
            for i, g in enumerate(grads):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *params[:3], float(params[3]), 1.0)
    if not len(kept):
        return net
    logits = _logits(net, x[kept])

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - y[kept] * logits / t))

    grid = np.geomspace(0.25, 8, 61)
    return net._replace(temperature=float(min(grid, key=loss)))


class Model(NamedTuple):
    words: list[str]
    vectors: np.ndarray
    net: Network | None


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Words and vectors of all documents, and a network from at most ``rows`` labelled ones, whose pooled vectors are collected."""
    bounded_batches(docs.sparkSession)
    words = frequent_words(docs)
    vectors = word_vectors(docs, words)
    sent = docs.sparkSession.sparkContext.broadcast((words, vectors))

    @F.arrow_udf("binary")
    def pool(texts: pa.Array) -> pa.Array:
        entries, vectors = entries_of(sent.value[0]), sent.value[1]
        return pa.array([pooled(entries.of(t.as_py()), vectors).astype(np.float32).tobytes() for t in texts], pa.binary())

    sample = labelled_texts(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    got = sample.select("doc_id", "label", pool("text").alias("x")).toArrow().sort_by("doc_id")
    sent.destroy()
    if not len(got):
        return Model(words, vectors, None)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    return Model(words, vectors, train(x.astype(float), got.column("label").to_numpy().astype(float)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: how likely the whole text is good."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def likely(texts: pa.Array) -> pa.Array:
        words, vectors, net = sent.value
        if net is None or not len(texts):
            return pa.array(np.full(len(texts), 0.5))
        entries = entries_of(words)
        return pa.array(probabilities(net, np.stack([pooled(entries.of(t.as_py() or ""), vectors) for t in texts])))

    return df.withColumn(out, likely(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
