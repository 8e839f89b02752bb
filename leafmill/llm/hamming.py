"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and each block of rows has a table for every segment from a value to the rows that
hold it. A query looks up all values within radius 0 of its segments, then 1, and so on; after radius r, every row of
distance up to ``segments * (r + 1) - 1`` has been met, since one of its segments at least is within r. The search ends
when the k-th verified distance is in that range, or when all codes were met, so results are exact, ties (smaller
id first) included. Where a radius has more values than a segment's table, the table's values are held against the
query's instead, so a small block costs what its values do.

All rows are indexed where they are read, in blocks of bounded size; queries come in blocks of a bounded number of
codes, which are broadcast. Equal codes are searched once: a block keeps the k smallest ids of each code, as no
others can be among the k nearest, and equal queries share one search. Blocks return k rows a query, which a window
with a limit before the shuffle merges.

Defined cases: a null vector has no code; it is neither indexed nor a query. Null, zero and not-a-number elements are
0 bits; short vectors are filled up with 0 bits, and longer ones than the code raise. Repeated rows are found as often
as they are there. A null id is an id after all others. A query is a row too and finds itself. With fewer than k
rows, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._common import written

#: Bits of a code, segments, rows indexed at once, query codes broadcast at once, and pairs looked at together.
BITS, SEGMENTS, BLOCK_ROWS, QUERY_BLOCK, TOGETHER = 64, 4, 1 << 20, 1 << 20, 1 << 20


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 elements as one ``long``: bit i is set if element i is over 0."""

    @F.arrow_udf("long")
    def code(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if len(lengths) and lengths.max() > BITS:
            raise ValueError(f"vectors of more than {BITS} elements")
        values = vectors.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        bits = np.zeros((len(vectors), BITS), np.uint8)
        bits[np.arange(BITS) < lengths[:, None]] = values > 0
        packed = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)
        return pa.array(packed, pa.int64(), mask=vectors.is_null().to_numpy(zero_copy_only=False))

    return code(vector)


class Index:
    """Segment tables over distinct codes; ``absent`` marks the rows whose id is null."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int, segments: int = SEGMENTS, absent: np.ndarray | None = None):
        absent = np.zeros(len(ids), bool) if absent is None else absent
        order = np.lexsort((ids, absent, codes))
        ids, codes, absent = ids[order], codes[order], absent[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        nth = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
        keep = nth < k  # no more ids of one code can be among the k nearest
        self.ids, self.absent, self.codes = ids[keep], absent[keep], codes[first]
        self.spans = np.r_[0, np.cumsum(np.add.reduceat(keep, first))] if len(first) else np.zeros(1, np.int64)
        self.k, self.segments, self.width = k, segments, BITS // segments
        self.tables = []
        for s in range(segments):
            values = self.segment(self.codes, s)
            ends = np.r_[0, np.cumsum(np.bincount(values, minlength=1 << self.width))]
            self.tables.append((np.argsort(values, kind="stable"), ends, np.flatnonzero(np.diff(ends))))

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _look(self, values: np.ndarray, s: int, radius: int, flips: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) of all values that are at this radius from the query's: by flipping bits, or over the table's values if these are fewer."""
        present = self.tables[s][2]
        over = present if len(present) < len(flips) else flips
        step = max(1, TOGETHER // max(1, len(over)))
        for at in range(0, len(values), step):
            part = values[at : at + step]
            if over is flips:
                yield np.repeat(np.arange(at, at + len(part)), len(flips)), (part[:, None] ^ flips[None, :]).ravel()
            else:
                q, v = np.nonzero(np.bitwise_count(part[:, None] ^ present[None, :]) == radius)
                yield at + q, present[v]

    def met(self, queries: np.ndarray, s: int, radius: int, flips: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, code) positions whose first meeting is segment s at this radius."""
        rows, ends, _ = self.tables[s]
        for of, look in self._look(self.segment(queries, s), s, radius, flips):
            count = ends[look + 1] - ends[look]
            hit = count > 0
            look, count, of = look[hit], count[hit], of[hit]
            bounds = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + TOGETHER, TOGETHER), side="left")
            for a, b in zip(bounds, np.r_[bounds[1:], len(count)]):
                if a == b:
                    continue
                n = count[a:b]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[look[a:b]], n)
                q, c = np.repeat(of[a:b], n), rows[place]
                apart = self.codes[c] ^ queries[q]
                new = np.ones(len(q), bool)
                for other in range(self.segments):
                    if other != s:
                        d = np.bitwise_count(self.segment(apart, other))
                        new &= d > radius if other < s else d >= radius
                yield q[new], c[new]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position in ``ids``, distance), up to k of each query, nearest first."""
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        live, met = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for radius in range(self.width + 1):
            if not len(live) or not len(self.codes):
                break
            flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(self.width), radius)], np.int64)
            for s in range(self.segments):
                for q, c in self.met(queries[live], s, radius, flips):
                    met += np.bincount(live[q], minlength=len(queries))
                    n = self.spans[c + 1] - self.spans[c]
                    q, c, place = np.repeat(live[q], n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.spans[c], n)
                    found = (q, place, np.bitwise_count(self.codes[c] ^ queries[q]).astype(np.int64))
                    best = self._nearest(tuple(np.concatenate(x) for x in zip(best, found)))
            # the k-th distance of those that have k
            q, _, d = best
            have = np.bincount(q, minlength=len(queries))
            kth = np.full(len(queries), BITS + 1)
            last = np.cumsum(have) - 1
            full = have >= self.k
            kth[full] = d[last[full]]
            covered = self.segments * (radius + 1) - 1
            live = live[(kth[live] > covered) & (met[live] < len(self.codes))]
        return best

    def _nearest(self, found: tuple) -> tuple:
        q, place, d = found
        order = np.lexsort((self.ids[place], self.absent[place], d, q))
        q, place, d = q[order], place[order], d[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = nth < self.k
        return q[keep], place[keep], d[keep]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k rows nearest to each query.

    ``rows`` and ``queries``: id long, code long. Each block of queries takes one pass over the rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = rows.sparkSession
    rows, queries = (df.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("code IS NOT NULL") for df in (rows, queries))
    asked = written(queries, "queries")
    distinct = asked.select("code").distinct()
    blocks = max(1, -(-distinct.count() // query_block))
    found = None
    for b in range(blocks):
        # about query_block codes of 8 bytes, whatever the number of queries
        block = distinct.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == b).toArrow().column("code").to_numpy()
        sent = spark.sparkContext.broadcast(np.sort(block))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def nearest() -> pa.RecordBatch:
                # whole numbers throughout: nulls are told by a mask, never by a floating-point column
                ids, codes, absent = (np.concatenate([f(x).to_numpy(zero_copy_only=False) for x in held]) for f in (lambda x: x.column("id").fill_null(0), lambda x: x.column("code"), lambda x: x.column("id").is_null()))
                index = Index(ids, codes.view(np.uint64), k, absent=absent)
                q, place, d = index.search(sent.value.view(np.uint64))
                return pa.RecordBatch.from_arrays([pa.array(sent.value[q]), pa.array(index.ids[place], mask=index.absent[place]), pa.array(d.astype(np.int32))], names=["code", "id", "distance"])

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= block_rows:
                    yield nearest()
                    held = []
            if any(x.num_rows for x in held):
                yield nearest()

        part = rows.mapInArrow(search, "code long, id long, distance int")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("code").orderBy("distance", F.col("id").asc_nulls_last())
    top = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
    return asked.select(F.col("id").alias("query_id"), "code").join(top, "code").select("query_id", "rank", "id", "distance")
