"""N-gram Jaccard join: exact links between documents' shingle sets, and their components, by signature trees.

1. A document's set is its distinct n-word shingles, as sorted 64-bit hashes. Equal sets are one class.
2. Blocks. Linked sets differ in at most a known number k of shingles, which follows from the threshold and the sizes.
   So the hash space is cut into k + t segments, and at least t segments of a linked pair are equal. A set has a key for
   each segment, and sets that share a key are tied. Frames of sizes settle k: a pair meets in the frame of its smaller
   member. In fact a linked pair shares t keys of that frame, so a set leaves out t - 1, if all sets leave out those that come
   first in one order of all keys: the last key that the pair shares is left out by neither. So k + 1 keys of each
   frame stay, and no linked pair is missed. First in that order are the keys of empty segments, then the ``MOST_HOT`` keys
   most often met (a list of a fixed size, which is broadcast), by frequency, then all others by their value. So a passage
   that many documents share ties none of them.
   Keys are combined in each task before the shuffle, so a key that a third of all documents have reaches the
   reducer once for each batch of rows; there sorted runs become stars, not pairs.
3. Ties make clusters, inside which all links lie. A task builds a signature tree over the sets it is sent: leaves of
   a few sets and inner nodes hold OR-combined bitmaps, ranges of sizes, and the most shingles that a bitmap hides. A dual
   traversal follows only node pairs whose largest possible overlap reaches the least that a link needs. What is left
   is verified against the sets, unless both are connected already.
4. A cluster of up to ``BLOCK`` classes is one task; one of up to ``WHOLE`` is cut into parts that meet in pairs, so a set is
   sent a bounded number of times. A larger one is never sent whole at first: its classes meet those with the
   same least hash, in parts, then a few of each part's components meet again by other sketches, which joins most near copies.
   What is exact comes last: the classes of a cluster that isn't connected yet meet as a whole. Where that would send
   each over ``COPIES`` times on average, they meet by every key whose classes aren't connected yet (keys with the same
   classes count once), if counts tell that this sends fewer. Groups over ``BLOCK`` are cut by size range and hash, and two parts meet where sizes allow
   a link and not both lie in the group's greatest component. There bitmaps of two to four bits a shingle meet first, in the same
   trees; a task is then sent the sets that these leave a partner, and no others.
5. Links (a spanning forest from each task) and classes give the components.

Defined cases: a null, empty or all-blank text has no shingles and is linked with nothing; with fewer words than n, the
whole sequence is one shingle. Rows that repeat an id are one document, linked to itself; if their texts differ, each
row keeps its own size. A null id is returned unlinked, without a component. Words are of any length, texts are read
whole. Columns other than id and text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches, let_go, written
from leafmill.llm._tokens import TokenIds, claim
from leafmill.llm.components import components

#: Classes of a cluster part, sets of a leaf, children of a node, and bits of a bitmap for each shingle of the largest set.
BLOCK, LEAF, FAN, BITS_EACH, MOST_BITS = 512, 8, 4, 8, 1 << 16
#: Classes up to which a cluster's parts all meet with their sets: 4 parts, so a set is sent about 4 times at most.
WHOLE = 4 * BLOCK

#: Bits for each shingle, at least, of the bitmaps that meet before sets do.
BITS_SENT = 2

#: Sketches of a set, and classes of a component that meet others by each sketch but the first, about.
SKETCHES, SAMPLE = 4, 64
#: Sketches are given up when links found by one are fewer than one in so many classes.
FEW = 20

#: Frequent keys that sets may leave out.
MOST_HOT = 1 << 18

#: Bits of the filter that says which documents' texts are wanted: 2^20 longs of 64, whatever the input is.
FILTER_BITS = 1 << 26

#: How often sets of an open cluster may be sent, as bitmaps, on average, before it's asked whether keys send fewer.
COPIES = 64

#: Keys that a task combines at once, and pairs of nodes that a traversal follows at once.
TOGETHER, PAIRS = 1 << 20, 1 << 18

#: Bytes of the bitmaps that are held against others at once: pairs' bitmaps are copied for that, so their number doesn't bound it.
MAP_BYTES = 1 << 20

_words = TokenIds(xxhash.xxh3_64_intdigest)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles. Bytes split where the contract's words end, and lower A-Z only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = _mix(h[: len(h) - n + 1] + np.uint64(n))
        for k in range(1, n):
            out = _mix(out * _A + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Threshold:
    """Jaccard of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("0 < num <= den")
        self.num, self.den = num, den

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least(self, total: int | np.ndarray) -> int | np.ndarray:
        """The least overlap that links sets of ``total`` shingles together."""
        return -(-self.num * total // (self.num + self.den))

    @cache
    def frames(self, size: int) -> list[tuple[int, int, int]]:
        """(frame, segments, spare) in which a set of this size has keys: its own, and others whose smaller members it may link with."""
        out = []
        for f in range(max(0, self.frame(size) - 2), self.frame(size) + 1):
            top = self.bounds(f)[1]
            if f < self.frame(size) and size * self.num > top * self.den:
                continue
            # the smaller has up to ``top`` shingles, the larger up to what the threshold allows
            total = top + min(top * self.den // self.num, 1 << 40)
            differ = total * (self.den - self.num) // (self.den + self.num)
            if differ:
                spare = 12 + differ // 8
                out.append((f, differ + spare, spare))
        return out

    @cache
    def bounds(self, f: int) -> tuple[int, int]:
        """Least and greatest size of a frame: two steps of the threshold wide."""
        low = 1 if f == 0 else self.bounds(f - 1)[1] + 1
        return low, max(low, low * self.den * self.den // (self.num * self.num))

    @cache
    def frame(self, size: int) -> int:
        f = 0
        while self.bounds(f)[1] < size:
            f += 1
        return f


def sketches(items: np.ndarray) -> np.ndarray:
    """Hashes of a set that sets like it are likely to share: the least and the greatest, in two orders."""
    mixed = _mix(items ^ _A)
    return np.array([items[0], mixed.min(), items[-1], mixed.max()], np.uint64).view(np.int64)


def keys(items: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys of a set: one for each segment of each frame, from the sum of the hashes in it; their last byte is the frame's.

    Those of empty segments are the first that a set leaves out, so only what there are beyond is made.
    """
    out = []
    mixed = _mix(items ^ _A)
    for f, segments, spare in t.frames(len(items)):
        # segments follow the order of the hashes, so each is a run
        at = ((items >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        with np.errstate(over="ignore"):
            seed = np.uint64((f * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
            made = [_mix(np.add.reduceat(mixed, first) + _mix(at[first] * _A + seed))]
            if segments - len(first) >= spare:
                empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), at[first])
                made.append(np.sort(_mix(_mix(empty * _A + seed) ^ _C))[spare - 1 :])
        out += [(k & ~np.uint64(255)) | np.uint64(f & 255) for k in made]
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def profile(docs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """doc_id, n_shingles, digest and sketches (null without shingles), keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, digests, offsets, found, drawn = [], [], [0], [], []
                for text in part.column("text"):
                    items = shingles(text.as_py(), n)
                    sizes.append(len(items))
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    drawn.append(sketches(items) if len(items) else None)
                    found.append(keys(items, t))
                    offsets.append(offsets[-1] + len(found[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(drawn, pa.list_(pa.int64())), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sketches", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketches array<long>, keys array<long>")


def leave_out(found: np.ndarray, size: int, often: np.ndarray, t: Threshold) -> np.ndarray:
    """Which of a set's keys stay: of each frame those that come last, by frequency (``often``; 0: not in the list) and value, as many as must."""
    stay = np.ones(len(found), bool)
    frame = found & 255
    for f, segments, spare in t.frames(size):
        own = np.flatnonzero(frame == f & 255)
        # sets share ``spare`` keys; of those left out, the ones of empty segments aren't here any more
        beyond = len(own) - (segments - spare) - 1
        if beyond > 0:
            stay[own[np.lexsort((found[own], -often[own]))][:beyond]] = False
    return stay


def frequent_keys(profiles: DataFrame) -> pa.Table:
    """key, n of the keys that are met most often, about: a task sends those that it meets twice among many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[times > 1]), pa.array(times[times > 1])], names=["key", "n"])

        for batch in batches:
            held.append(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= TOGETHER:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    met = profiles.where("size(keys) > 0").select("keys").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return met.orderBy(F.desc("n"), "key").limit(MOST_HOT).toArrow().sort_by("key")


class Hot:
    """Frequent keys, sorted, and how often they are met; sets leave out what they may."""

    def __init__(self, found: pa.Table, t: Threshold):
        self.keys, self.times, self.t = found.column("key").to_numpy(), found.column("n").to_numpy(), t

    def keep(self, flat: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which keys stay: ``flat`` has those of all sets, one set after another."""
        often = np.zeros(len(flat), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
            often = np.where(self.keys[at] == flat, self.times[at], 0)
        ends = np.cumsum(lengths)
        stay = [leave_out(flat[end - n : end], int(size), often[end - n : end], self.t) for end, n, size in zip(ends, lengths, sizes)]
        return np.concatenate(stay) if stay else np.ones(0, bool)


def _kept(batch: pa.RecordBatch, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Keys that stay, and the row of each."""
    lists = batch.column("keys")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    stay = hot.keep(flat, lengths, batch.column("n_shingles").to_numpy(zero_copy_only=False))
    return flat[stay], np.repeat(np.arange(batch.num_rows), lengths)[stay]


def _runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and id: keys once with their smallest id, and a (doc, smallest) pair for every other id."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    least = doc[first][np.cumsum(first) - 1] if len(key) else doc
    other = doc != least
    return key[first], doc[first], np.unique(np.stack((doc[other], least[other]), axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)


def ties(profiles: DataFrame, hot) -> DataFrame:
    """a, b: a star of ids for every shared key that sets keep; ``hot``: a broadcast ``Hot``."""
    kind = "key long, doc long, least long"

    def batch_of(key, doc, least) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.nulls(len(key), pa.int64()) if least is None else pa.array(least)], names=["key", "doc", "least"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, doc, pairs = _runs(*(np.concatenate(x) for x in zip(*held)))
            yield batch_of(key, doc, None)
            if len(pairs):  # these have their tie already; they go anywhere
                yield batch_of(_mix(pairs[:, 0].astype(np.uint64)).view(np.int64), pairs[:, 0], pairs[:, 1])

        for batch in batches:
            key, row = _kept(batch, hot.value)
            held.append((key, batch.column("doc_id").to_numpy(zero_copy_only=False)[row]))
            n += len(key)
            if n >= TOGETHER:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: a key's first id is tied to each other one; a key may go on in the next batch."""
        last: tuple[int, int] | None = None
        for batch in batches:
            key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc"))
            tied = batch.column("least").is_valid().to_numpy(zero_copy_only=False)
            pairs = [np.stack((doc[tied], batch.column("least").filter(pa.array(tied)).to_numpy(zero_copy_only=False)), axis=1)]
            key, doc = key[~tied], doc[~tied]
            if len(key):
                first = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
                least = np.r_[last[1] if last else doc[0], doc[first]][np.cumsum(first)]
                last = (int(key[-1]), int(least[-1]))
                other = doc != least
                pairs.append(np.stack((doc[other], least[other]), axis=1))
            a = np.unique(np.concatenate(pairs), axis=0)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])

    rows = profiles.where("doc_id IS NOT NULL AND size(keys) > 0").select("doc_id", "n_shingles", "keys").mapInArrow(combine, kind)
    return rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(star, "a long, b long").distinct()


def width(size: int, each: int) -> int:
    """Bits of a bitmap for sets of up to ``size`` shingles, at least ``each`` for one: a power of two."""
    return min(MOST_BITS, max(512, 1 << (each * size - 1).bit_length()))


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, bool)
    marks[(items & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks)


class Tree:
    """A signature tree over bitmaps of sets: levels from the leaves up, each a range of the level below.

    A bitmap of fewer bits than others is repeated up to theirs. A shingle that it shares with one of these still has its
    bit in both, so what they have in common and what the bitmap as it was sent hides remain a bound of the overlap.
    """

    def __init__(self, maps: list[np.ndarray], sizes: list[int], order: list[int], bits: int):
        self.order, self.sizes = order, np.array([sizes[i] for i in order], np.int64)
        rows = np.stack([np.tile(maps[i], bits // (8 * len(maps[i]))) for i in order])
        hidden = self.sizes - np.array([int(np.bitwise_count(maps[i]).sum(dtype=np.int64)) for i in order], np.int64)
        #: Of each level: bitmaps, least and greatest size, and the most shingles that share a bit with another.
        self.levels = [(rows.view(np.uint64), self.sizes, self.sizes, hidden)]
        for fan in (LEAF, *[FAN] * 40):
            maps, low, high, hidden = self.levels[-1]
            if len(low) == 1:
                break
            starts = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(hidden, starts)))

    @classmethod
    def of(cls, sets: list[np.ndarray], bits: int) -> Tree:
        # alike sets have the same smallest hashes more often than not, so they are neighbours
        order = sorted(range(len(sets)), key=lambda i: (sets[i][0], len(sets[i])))
        tree = cls([bitmap(s, bits) for s in sets], [len(s) for s in sets], order, bits)
        tree.sets = [sets[i] for i in order]
        return tree

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def _possible(one: tuple, i: np.ndarray, other: tuple, j: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Whether members of node i and node j can be linked, and the largest overlap they can have."""
    (maps, low, high, hidden), (maps2, low2, high2, hidden2) = one, other
    sizes = (t.num * low2[j] <= t.den * high[i]) & (t.num * low[i] <= t.den * high2[j])
    most = np.zeros(len(i), np.int64)
    at = np.flatnonzero(sizes)
    step = max(1, MAP_BYTES // maps[0].nbytes)
    for a in range(0, len(at), step):
        p = at[a : a + step]
        most[p] = np.bitwise_count(maps[i[p]] & maps2[j[p]]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[i[p]], hidden2[j[p]])
    most = np.minimum(most, np.minimum(high[i], high2[j]))
    return sizes & (most >= t.least(low[i] + low2[j])), most


def dual_traversal(one: Tree, other: Tree, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that their bitmaps don't rule out, likeliest first in each batch. ``one is other``: each pair once."""
    depth = max(len(one.levels), len(other.levels)) - 1
    of = lambda tree, level: tree.levels[min(level, len(tree.levels) - 1)]
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep, most = _possible(of(one, level), i, of(other, level), j, t)
        if level == 0:
            if one is other:
                keep &= i < j
            order = np.argsort(-most[keep], kind="stable")
            yield i[keep][order], j[keep][order]
            continue
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        # the children of either node; a tree of fewer levels stands still at its root
        kids = [(n[:, None] * tree.fan(level) + np.arange(tree.fan(level)) if level < len(tree.levels) else n[:, None], tree) for n, tree in ((i, one), (j, other))]
        (ci, _), (cj, _) = kids
        a = np.repeat(ci, cj.shape[1], axis=1).ravel()
        b = np.tile(cj, (1, ci.shape[1])).ravel()
        real = (a < len(of(one, level - 1)[1])) & (b < len(of(other, level - 1)[1]))
        if one is other:
            real &= a <= b
        a, b = a[real], b[real]
        for at in range(0, len(a), PAIRS):
            stack.append((level - 1, a[at : at + PAIRS], b[at : at + PAIRS]))


class Forest:
    """Sets that are connected; those of one root are from the start."""

    def __init__(self, n: int, roots: list[int] | None = None):
        first: dict[int, int] = {}
        self.up = list(range(n)) if roots is None else [first.setdefault(r, i) for i, r in enumerate(roots)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def links(one: list[np.ndarray], other: list[np.ndarray] | None, t: Threshold, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``one``, or between ``one`` and ``other``: positions, those of ``other`` after those of ``one``.

    Sets of one root are known to be connected.
    """
    bits = width(max(len(s) for s in (*one, *(other or ()))), BITS_EACH)
    left = Tree.of(one, bits)
    right = left if other is None else Tree.of(other, bits)
    shift = 0 if other is None else len(one)
    forest, out = Forest(len(one) + (len(other) if other else 0), roots), []
    for i, j in dual_traversal(left, right, t):
        for a, b in zip(i.tolist(), j.tolist()):
            p, q = left.order[a], right.order[b] + shift
            x, y = forest.root(p), forest.root(q)
            if x == y:
                continue
            u, v = left.sets[a], right.sets[b]
            both = len(u) + len(v) - len(np.union1d(u, v))
            if t.linked(len(u), len(v), both):
                forest.up[x] = y
                out.append((p, q))
    return out


def partnered(one: list[tuple[np.ndarray, int, int]], other: list[tuple[np.ndarray, int, int]] | None, t: Threshold) -> np.ndarray:
    """Which sets, as (bitmap, size, root), may be linked with one of another root: those of ``one``, then of ``other``."""
    bits = 8 * max(len(m[0]) for m in (*one, *(other or ())))

    def tree(side: list[tuple[np.ndarray, int, int]]) -> Tree:
        maps, sizes, _ = zip(*side)
        return Tree(maps, sizes, sorted(range(len(side)), key=lambda i: (sizes[i], maps[i].tobytes())), bits)

    left = tree(one)
    right = left if other is None else tree(other)
    shift = 0 if other is None else len(one)
    roots = np.array([m[2] for m in (*one, *(other or ()))], np.int64)
    own, others = np.array(left.order), np.array(right.order) + shift
    out = np.zeros(len(roots), bool)
    for i, j in dual_traversal(left, right, t):
        a, b = own[i], others[j]
        apart = roots[a] != roots[b]
        out[a[apart]] = out[b[apart]] = True
    return out


def _met(rows: DataFrame, *group: str) -> DataFrame:
    """Adds ``task``: rows of a group meet, in parts of about ``BLOCK`` by hash; groups that are connected already go."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.ceil(F.col("n") / BLOCK))
    return rows.join(sizes, list(group)).withColumn("task", F.xxhash64(*group, part)).drop("n", "low", "high")


def _filtered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc`` may be in ``wanted``: a bit array of ``FILTER_BITS`` is broadcast, so some others stay as well."""
    at = F.pmod(F.xxhash64("doc", F.lit("filter")), F.lit(FILTER_BITS))
    word, bit = F.shiftright("at", 6), F.expr("shiftleft(1L, cast(at & 63 AS int))")
    marks = wanted.select(at.alias("at")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = docs.withColumn("at", at).join(F.broadcast(written(marks, "marks")), word == F.col("word"))
    return marked.where((F.col("bits").bitwiseAND(bit)) != 0).select(*docs.columns)


def _sets(docs: DataFrame, candidates: DataFrame, n: int, t: Threshold) -> DataFrame:
    """node, large, tasks, size, map, items of every class of a cluster, written: its set and that's bitmap, and the tasks where it meets others first."""
    sizes = written(candidates.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    known = written(candidates.join(sizes, "cluster").withColumn("large", F.col("size") > WHOLE), "known")
    rows = known.select("node", "cluster", "size", "large", "n_shingles", F.col("node").alias("root"), F.lit(None).cast("long").alias("most"), F.col("sketches")[0].alias("sketch"))
    first = _met(rows.where("large"), "cluster", "sketch").select("node", "task", F.lit(-1).alias("side"))
    tasks = _dealt(rows.where("NOT large"), "cluster", t).select("node", "task", "side").unionByName(first)
    # a class whose sketch is its own alone meets no one yet, but its set is wanted all the same
    own = tasks.groupBy("node").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    wanted = written(known.select("node", "doc", "digest", "large").join(own, "node", "left"), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [shingles(text.as_py(), n) for text in part.column("text")]
                same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(found, part.column("digest"))], pa.bool_())
                made = [pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap(s, width(len(s), BITS_SENT)).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(same) for c in (*(part.column(c) for c in names), *made)], names=[*names, "size", "map", "items"])

    names = ["node", "large", "tasks"]
    # what is wanted grows with the input: joined by shuffle at every size, never broadcast; most other texts stay where they are
    texts = _filtered(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), wanted).join(wanted.hint("merge"), "doc").select(*names, "digest", "text")
    return written(texts.mapInArrow(read, "node long, large boolean, tasks array<struct<task: bigint, side: int>>, size long, map binary, items binary"), "sets")


def _linked(rows: DataFrame, t: Threshold) -> DataFrame:
    """a, b: a spanning forest of the links in each task. ``rows``: task, side (-1: all meet; 0 and 1: the two sides meet), node, root, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, {}

        def found() -> pa.RecordBatch:
            sides = [[m for m in members.values() if m[0] == s] for s in (-1, 0, 1)]
            pairs, all_ = [], [m for side in sides for m in side]
            if len(sides[0]) > 1:
                pairs = links([m[3] for m in sides[0]], None, t, [m[2] for m in sides[0]])
            elif sides[1] and sides[2]:
                pairs = links([m[3] for m in sides[1]], [m[3] for m in sides[2]], t, [m[2] for m in all_])
            return pa.RecordBatch.from_arrays([pa.array([all_[p[k]][1] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, side, node, root, items in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node", "root")), batch.column("items")):
                if key != task:
                    if len(members) > 1:
                        yield found()
                    task, members = key, {}
                members[side, node] = (side, node, root, np.frombuffer(items.as_py(), np.uint64))
        if len(members) > 1:
            yield found()

    return rows.select("task", "side", "node", "root", "items").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _partnered(rows: DataFrame, t: Threshold) -> DataFrame:
    """task, side, node, root of the sets whose bitmaps leave them a partner in their task. ``rows``: task, side, node, root, size, map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, {}

        def found() -> pa.RecordBatch:
            sides = [[m for m in members if m[0] == s] for s in (-1, 0, 1)]
            kept = []
            if len(sides[0]) > 1:
                stay = partnered([members[m] for m in sides[0]], None, t)
                kept = [m for m, k in zip(sides[0], stay) if k]
            elif sides[1] and sides[2]:
                stay = partnered([members[m] for m in sides[1]], [members[m] for m in sides[2]], t)
                kept = [m for m, k in zip(sides[1] + sides[2], stay) if k]
            columns = [pa.array([task] * len(kept), pa.int64()), pa.array([m[0] for m in kept], pa.int32()), pa.array([m[1] for m in kept], pa.int64()), pa.array([members[m][2] for m in kept], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["task", "side", "node", "root"])

        for batch in batches:
            for key, side, node, root, size, data in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node", "root", "size")), batch.column("map")):
                if key != task:
                    if len(members) > 1:
                        yield found()
                    task, members = key, {}
                members[side, node] = (np.frombuffer(data.as_py(), np.uint8), size, root)
        if len(members) > 1:
            yield found()

    return rows.select("task", "side", "node", "root", "size", "map").repartition("task").sortWithinPartitions("task").mapInArrow(run, "task long, side int, node long, root long")


def _ranges(rows: DataFrame, group: str, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Rows with their range of sizes; and of each group, part of it (in its greatest component or not) and range: the parts of about ``BLOCK`` and those it meets."""
    step = 1.0001 * float(np.log(t.den / t.num)) or 1.0
    ranged = rows.withColumn("range", F.floor(F.log(F.col("n_shingles")) / F.lit(step)).cast("int")).withColumn("great", F.col("root").eqNullSafe(F.col("most")))
    counts = written(ranged.groupBy(group, "great", "range").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "ranges")
    # a row for each range of a group of over BLOCK classes
    one, other = counts.alias("a"), counts.alias("b")
    near = one.join(other, F.col(f"a.{group}") == F.col(f"b.{group}")).where((F.abs(F.col("a.range") - F.col("b.range")) <= 1) & ~(F.col("a.great") & F.col("b.great")))
    near = near.groupBy(f"a.{group}", "a.great", "a.range").agg(F.first("a.n").alias("n"), F.first("a.parts").alias("own"), F.sum("b.parts").alias("times"), F.collect_list(F.struct("b.great", "b.range", "b.parts")).alias("near"))
    return ranged, written(near, "near")


def _dealt(rows: DataFrame, group: str, t: Threshold) -> DataFrame:
    """node, root, task, side: the tasks of groups' classes. ``rows``: group, size (of the group), most (its greatest component), node, root, n_shingles."""
    small = rows.where(F.col("size") <= BLOCK).select("node", "root", F.xxhash64(group).alias("task"), F.lit(-1).alias("side"))
    ranged, near = _ranges(rows.where(F.col("size") > BLOCK), group, t)
    dealt = ranged.join(near, [group, "great", "range"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("own")).cast("int"))
    mine = F.struct("great", "range", "part")
    theirs = F.explode(F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x.parts - 1), lambda p: F.struct(x.great.alias("great"), x["range"].alias("range"), p.alias("part"))))))
    pairs = dealt.withColumn("mine", mine).withColumn("theirs", theirs)
    task = F.xxhash64(group, F.least("mine", "theirs"), F.greatest("mine", "theirs"))
    side = F.when(F.col("mine") == F.col("theirs"), -1).when(F.col("mine") < F.col("theirs"), 0).otherwise(1)
    return small.unionByName(pairs.select("node", "root", task.alias("task"), side.alias("side")))


def _last_tasks(profiles: DataFrame, hot, open_: DataFrame, t: Threshold) -> DataFrame:
    """node, root, task, side: the tasks where classes of clusters that aren't connected yet meet, as a whole or by shared keys."""
    names = ["node", "root", "cluster", "n_shingles"]
    sizes = open_.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
    whole = written(open_.select(*names).join(sizes.select("cluster", "size", "most.root").withColumnRenamed("root", "most"), "cluster"), "whole")
    # how often sets would be sent as a whole; keys are dealt only for clusters where that is often
    copies = _ranges(whole, "cluster", t)[1].groupBy("cluster").agg(F.sum(F.col("n") * F.col("times")).alias("as_whole"), F.sum("n").alias("n"))
    often = written(copies.where(F.col("as_whole") > COPIES * F.col("n")).select("cluster", "as_whole"), "often")
    if often.isEmpty():
        return _dealt(whole, "cluster", t)
    by_key = _shared_keys(profiles, hot, open_.join(often.select("cluster"), "cluster"))
    keyed_copies = by_key.groupBy("cluster").agg(F.sum(F.ceil(F.col("size") / BLOCK)).alias("by_key"))
    fewer = written(often.join(keyed_copies, "cluster", "left").where(F.coalesce("by_key", F.lit(0)) < F.col("as_whole")).select("cluster"), "way")
    as_whole = whole.join(fewer, "cluster", "left_anti")
    return _dealt(as_whole, "cluster", t).unionByName(_dealt(by_key.join(fewer, "cluster"), "key", t))


def _shared_keys(profiles: DataFrame, hot, open_: DataFrame) -> DataFrame:
    """node, root, cluster, n_shingles, key, most, size, written: every class under its keys whose classes aren't connected yet; of keys with the same classes, one."""
    own = open_.select(F.col("doc").alias("doc_id"), "digest", "node", "root", "cluster", "n_shingles")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = _kept(batch, hot.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in names), pa.array(key)], names=[*names, "key"])

    names = ["node", "root", "cluster", "n_shingles"]
    classes = profiles.select("doc_id", "digest", "keys").join(own, ["doc_id", "digest"]).select(*names, "keys")
    all_ = classes.mapInArrow(each, "node long, root long, cluster long, n_shingles long, key long")
    loose = all_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    # rows that repeat an id with its text give a class's keys again
    keyed = written(all_.join(loose, "key").distinct(), "keyed")
    # of a key: its classes, their greatest component, and a digest of which they are
    groups = keyed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit("sum")) % (1 << 31)).alias("s"))
    groups = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    once = groups.groupBy("n", "x", "s").agg(F.min(F.struct("key", F.col("most.root").alias("most"))).alias("k")).select("k.key", "k.most", F.col("n").alias("size"))
    return written(keyed.join(once, "key"), "by_key")


def verified(docs: DataFrame, profiles: DataFrame, hot, candidates: DataFrame, n: int, t: Threshold) -> DataFrame:
    """a, b: links that connect whatever is linked. ``candidates``: node, doc (an id with that set), cluster, digest, n_shingles, sketches of every class in one."""
    sets = _sets(docs, candidates, n, t)
    let_go(docs.sparkSession)
    sent = sets.select("node", "items", F.explode("tasks").alias("at")).select("at.task", "at.side", "node", F.col("node").alias("root"), "items")
    first = written(_linked(sent, t), "links")
    large = written(candidates.join(sets.where("large").select("node"), "node"), "large")
    if large.isEmpty():
        return first
    found = written(first.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "links")
    let_go(docs.sparkSession)
    every, sketch = first, 1
    while True:
        joined = components(found)
        rooted = written(large.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"), "roots")
        mixed = rooted.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cluster")
        open_ = written(rooted.join(mixed, "cluster"), "open")
        if open_.isEmpty():
            return every
        # sketches only save work: where components are of few classes, and where few met by the last one, the exact way is next
        few = open_.select("root").distinct().count() * 2 > open_.count()
        last = few or sketch == SKETCHES
        if last:
            tasks = _last_tasks(profiles, hot, open_, t)
            let_go(docs.sparkSession)
            tasks = written(_partnered(sets.where("large").select("node", "size", "map").join(tasks, "node"), t), "partnered")
        else:
            of = open_.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SAMPLE).alias("share"))
            some = open_.join(of, "root").where(F.pmod(F.xxhash64("node", F.lit(sketch)), F.col("share")) == 0)
            tasks = _met(some.select("node", "root", "cluster", F.col("sketches")[sketch].alias("sketch")), "cluster", "sketch").select("node", "root", "task", F.lit(-1).alias("side"))
        more = written(_linked(sets.where("large").select("node", "items").join(tasks, "node"), t), "links")
        found, every = found.unionByName(more), every.unionByName(more)
        if last:
            return every
        sketch = sketch + 1 if more.count() * FEW > open_.count() else SKETCHES


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of every row."""
    t = Threshold(num, den)
    bounded_batches(docs.sparkSession)
    profiles = written(profile(docs, n, t), "profiles")
    hot = docs.sparkSession.sparkContext.broadcast(Hot(frequent_keys(profiles), t))
    narrow = profiles.select("doc_id", "n_shingles", "digest")
    known = profiles.where("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", "n_shingles", "digest", "sketches")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches"))
    classes = written(classes.withColumn("node", F.xxhash64("digest")), "classes")
    clusters = components(ties(profiles, hot)).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    candidates = written(classes.join(clusters, "doc").select("node", "doc", "cluster", "digest", "n_shingles", "sketches"), "candidates")
    let_go(docs.sparkSession)
    found = verified(docs, profiles, hot, candidates, n, t)
    # rows of one id are one document, so the classes of its texts are tied as well
    many = written(known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id", F.xxhash64("a").alias("a")), "many")
    repeated = known.select("doc_id", "digest").join(many, "doc_id").select("a", F.xxhash64("digest").alias("b"))
    labels = components(found.unionByName(repeated))
    labelled = classes.join(labels, "node", "left").select("digest", "doc", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("least"))
    named = written(labelled.join(least, "component").select("digest", "least"), "labels")
    rows = narrow.join(named, "digest", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
