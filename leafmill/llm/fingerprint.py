"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of the text ends a chunk wherever it is ``block size - 1`` modulo the block
size, so boundaries move with the text around them. Each chunk's checksum becomes one symbol of 12 bits, and a
fingerprint is ``block size:symbols at that size:symbols at twice that size``. The block size, 3 times a power of two,
is the least that gives at most 64 symbols for the text's length, halved while fewer than 32 come out, and doubled while
more than 64 do and twice the size gives 32 at least. Where no size gives 32 to 64 (a passage that repeats has its
boundaries as often as it occurs), all chunks of the size are kept, and beyond 1,024 they are joined by twos, fours, …
over the whole text, each doubling counting as one of the block size. What follows the 63rd boundary is one symbol only
where it is no longer than 64 bytes or four block sizes. Fingerprints of equal or neighbouring block sizes
are compared by edit distance (insertions and deletions) between the symbols they have at a common size.

Defined cases: a null text is an empty one; its fingerprint is ``3::``, of likeness 1 to another empty one and 0 to
all else. Equal texts have equal fingerprints. Rows are ordered by id, nulls first, then by text, so ties and repeated
rows have a defined order; the row after the last is the first, which may be the row itself. An empty table gives an
empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches, shuffle_partitions

#: Bytes the rolling hash looks at, most and least symbols, and the least block size.
WINDOW, MOST, LEAST, SMALLEST = 7, 64, 32, 3

#: Bytes, and block sizes, that may follow the last but one symbol of MOST without having boundaries of their own.
REST, REST_SIZES = 64, 4

#: Symbols of a text for which no block size gives LEAST to MOST: beyond these, neighbouring chunks are joined.
KEPT = 1024

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = [a + b for a in _DIGITS for b in _DIGITS]

#: Ranges of ids for each shuffle partition: enough that hashing them deals out evenly.
RANGES = 4


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the window's sum, its weighted sum, and its shifted exclusive or."""
    n = len(data)
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = data
    out, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        at = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        out += at * np.uint32(WINDOW - back + 1)
        mixed ^= at << np.uint32(5 * back) if 5 * back < 32 else np.uint32(0)
    return out + mixed


def _symbols(data: bytes, ends: np.ndarray) -> str:
    bounds = [0, *ends.tolist()]
    if bounds[-1] < len(data):
        bounds.append(len(data))
    return "".join([_SYMBOLS[zlib.crc32(data[a:b]) & 0xFFF] for a, b in zip(bounds, bounds[1:])])


def signature(data: bytes, hashes: np.ndarray) -> str:
    """The fingerprint of a text from its bytes and their rolling hashes."""
    size = SMALLEST
    while size * MOST < len(data):
        size *= 2
    while True:
        at = np.flatnonzero(hashes % np.uint32(size) == np.uint32(size - 1))
        if size == SMALLEST or len(at) + 1 >= LEAST:
            break
        size //= 2
    while True:
        # a boundary at twice the size is one at the size itself
        wide = at[hashes[at] % np.uint32(2 * size) == np.uint32(2 * size - 1)]
        rest = len(data) - int(at[MOST - 2]) - 1 if len(at) >= MOST else 0
        if rest <= max(REST, REST_SIZES * size):
            at, wide = at[: MOST - 1], wide[: MOST - 1]
            break
        if len(wide) + 1 < LEAST:
            break
        at, size = wide, 2 * size
    # joined in the wide symbols from half of KEPT on, so that texts on either side of KEPT have a common size
    if len(at) > KEPT // 2:
        wide = at[1::2]
    while len(at) >= KEPT:
        at, wide, size = wide, wide[1::2], 2 * size
    return f"{size}:{_symbols(data, at + 1)}:{_symbols(data, wide + 1)}"


def fingerprint_text(text: str | None) -> str:
    data = (text or "").encode()
    return signature(data, rolling(np.frombuffer(data, np.uint8)))


def common_symbols(a: str, b: str) -> int:
    """Length of the longest common subsequence of symbols, a column of its table at a time as the bits of a number."""
    places: dict[str, int] = {}
    for i in range(0, len(a), 2):
        places[a[i : i + 2]] = places.get(a[i : i + 2], 0) | 1 << (i // 2)
    full = (1 << len(a) // 2) - 1
    row = full
    for i in range(0, len(b), 2):
        if (hit := places.get(b[i : i + 2])) is not None:
            both = row & hit
            row = (row + both | row - both) & full
    return len(a) // 2 - row.bit_count()


def _alike(a: str, b: str) -> float:
    return 4 * common_symbols(a, b) / (len(a) + len(b)) if a and b else 0.0


def compare(one: str, other: str) -> float:
    """1 less the edit distance's share of all symbols, at the best common block size; 0 if there is none."""
    if one == other:
        return 1.0
    (size, a, aa), (size2, b, bb) = one.split(":"), other.split(":")
    x, y = int(size), int(size2)
    if x == y:
        return max(_alike(a, b), _alike(aa, bb))
    return _alike(a, bb) if x == 2 * y else _alike(aa, b) if y == 2 * x else 0.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint_text(t.as_py()) for t in texts), pa.string(), size=len(texts))

    return of(text)


def likeness(one: Column, other: Column) -> Column:
    """The likeness, 0 to 1, of two fingerprint columns."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else compare(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return of(one, other)


def _next_pairs(docs: DataFrame, ranges: int) -> DataFrame:
    """bucket, ahead, key, doc_id, text: each range of ids together with the row that follows it, marked ``ahead``.

    The bounds are ids that occur, so the first row of the next range is known by its id alone, and the texts are
    shuffled once. They are as many as the ranges, whatever the number of rows.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = F.array(*(F.lit(i / ranges) for i in range(ranges)))
    least, cuts = rows.agg(F.min("key"), F.percentile_approx("key", shares, max(10_000, 20 * ranges))).first()
    bounds = np.unique(np.array([least, *(cuts or [])], np.int64)) if least is not None else np.zeros(1, np.int64)

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        return pa.array(np.maximum(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="right") - 1, 0).astype(np.int32))

    @F.arrow_udf("boolean")
    def opens(keys: pa.Array) -> pa.Array:
        k = keys.to_numpy(zero_copy_only=False)
        return pa.array(bounds[np.maximum(np.searchsorted(bounds, k, side="right") - 1, 0)] == k)

    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("b") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("b", bucket("key")).withColumn("to", F.explode(F.when(opens("key"), F.array(own, before)).otherwise(F.array(own))))
    return dealt.select("to.bucket", "to.ahead", "key", "doc_id", "text")


EDITS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints every text and an edit of it, and compares it with that edit and with the next document.

    The edit's last quarter (code points, rounded down) is replaced by the first as many of the next document in
    ascending id. Partitions are streamed in order, with one row held at a time.
    """
    bounded_batches(docs.sparkSession)
    pairs = _next_pairs(docs, RANGES * shuffle_partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EDITS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out: list[tuple] = []
        held, ended = None, None  # the row before: bucket, id, text, bytes, hashes, fingerprint; a bucket whose next row was seen
        for batch in batches:
            for bucket, ahead, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if ahead and (ended == bucket or held is None or held[0] != bucket):
                    continue
                text = text.as_py()
                data = text.encode()
                hashes = rolling(np.frombuffer(data, np.uint8))
                found = signature(data, hashes)
                if held is not None and held[0] == bucket:
                    out.append(_edit(held, text, found))
                held, ended = (None, bucket) if ahead else ((bucket, doc_id, text, data, hashes, found), None)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return pairs.repartition("bucket").sortWithinPartitions("bucket", "ahead", "key", "text").drop("key").mapInArrow(run, EDITS)


def _edit(row: tuple, next_text: str, next_found: str) -> tuple:
    _, doc_id, text, data, hashes, found = row
    cut = len(text) // 4
    kept = text[: len(text) - cut].encode()
    edited = kept + next_text[:cut].encode()
    # the hashes of what is kept stay as they are
    tail = rolling(np.frombuffer(edited[max(0, len(kept) - WINDOW + 1) :], np.uint8))[min(len(kept), WINDOW - 1) :]
    other = signature(edited, np.concatenate((hashes[: len(kept)], tail)))
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), found, other, compare(found, other), compare(found, next_found)
