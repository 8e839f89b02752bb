"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

Text is cut by the vocabulary's pattern, and each cut is merged on its own. The merge loop keeps a segment tree
over the byte positions: leaf i holds the rank of the pair that starts at live node i, inner nodes hold the
smaller of their children as (rank, position), so the root is the leftmost pair of the least rank. A merge joins
two neighbours in a linked list and updates three leaves, each in logarithmic time. A piece of n bytes thus costs
O(n log n) however long it is, as a run of one letter over a whole document may be.

Frequent words are looked up in a bounded cache. A text is first split at single spaces between two characters
that aren't white space: the pattern always cuts there, and what is on either side doesn't matter to the other.

Defined cases: a null text encodes as an empty one, to no ids; special tokens are never made from text. Decoding
takes any ids of the vocabulary and gives bytes; unknown ids raise. The output column replaces an input column of
the same name, other columns pass through, repeated rows are encoded alike, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches, fresh
from leafmill.llm._tokens import CACHED_CHARS, claim, keeps

#: Bounds of a worker's caches, in entries: words of a text, and pieces that the pattern cuts.
CACHED_WORDS, CACHED_PIECES = 1 << 17, 1 << 16
#: Characters of text that are encoded together, and bytes of a piece up to which pieces are merged together.
BATCH_CHARS, TOGETHER = 2_000_000, 64

#: Fixed value: the pattern for which the two short cuts below hold; with any other, texts are cut by it alone.
SPLIT_PATTERN = public_tokenizers.PATTERN
#: Where a text may be cut before the pattern is tried. Python's \S leaves out all that is white space in Unicode.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A space or none, letters, and marks of ASCII: what the pattern cuts into one or two pieces. No mark before the letters, so no contraction.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-/:-@\[-`{-~]*)")

_loaded: dict[tuple[str, str], "Codec"] = {}
keeps(_loaded.clear)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64, a space, and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until none has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    rank = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = 1 << 62
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    # follow[i]: start of the node after node i; before[i]: start of the node before it
    follow, before = list(range(1, n + 2)), list(range(-1, n))

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = follow[i]
        k = follow[j]
        follow[i] = k
        before[k] = i
        changes = [(j, none)]
        value = none
        if k < n and (r := rank(piece[i : follow[k]])) is not None:
            value = r << 32 | i
        changes.append((i, value))
        p = before[i]
        if p >= 0:
            r = rank(piece[p:k])
            changes.append((p, none if r is None else r << 32 | p))
        for at, value in changes:
            at += size
            if at >= 2 * size:  # the last node starts no pair
                continue
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : follow[i]]])
        i = follow[i]
    return out


class PairTable:
    """Rank of the token that two neighbouring tokens make, for arrays of pairs: an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.mask = np.int64((1 << max(4, (4 * len(pairs)).bit_length())) - 1)
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(34)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, -1 for pairs that make no token."""
        keys = left << 32 | right
        slots = self._slot(keys)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            got = self.keys[slots]
            hit = got == keys
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (got != -1)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & self.mask
        return out


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> list[bytes]:
    """``merge`` of many short pieces together, packed: a segment tree for each, all of one size, as columns of one array."""
    m, size = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    bits, none = size.bit_length(), np.int64(1 << 62)
    length = np.fromiter(map(len, pieces), np.int64, m)
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    ids = single[raw]
    start = np.arange(size) < length[:, None]
    if (ids[start] < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    follow = np.tile(np.arange(1, size + 1), (m, 1))
    before = np.tile(np.arange(-1, size), (m, 1))  # one more column: the node after the last
    tree = np.full((2 * size, m), none)
    for i in range(size - 1):
        r = pairs.find(ids[:, i], ids[:, i + 1])
        tree[size + i] = np.where((r >= 0) & (i + 1 < length), r << bits | i, none)
    for k in range(size - 1, 0, -1):
        tree[k] = np.minimum(tree[2 * k], tree[2 * k + 1])

    # from here on all arrays are flat, a piece's entries side by side
    tree, ids, start, follow, before = np.ascontiguousarray(tree.T).ravel(), ids.ravel(), start.ravel(), follow.ravel(), before.ravel()
    live = np.arange(m)
    while True:
        root = tree.take(live * (2 * size) + 1)
        on = root != none
        live, root = live[on], root[on]
        if not len(live):
            break
        row, end = live * size, length.take(live)
        i = root & (1 << bits) - 1
        here = row + i
        ids[here] = root >> bits
        j = follow.take(here)
        k = follow.take(row + j)
        start[row + j] = False
        follow[here] = k
        before[live * (size + 1) + k] = i
        p = before.take(live * (size + 1) + i)
        # the pairs (node i, node k) and (node p, node i); neither if there is no such neighbour
        q = np.maximum(p, 0)
        rank = pairs.find(np.concatenate((ids.take(here), ids.take(row + q))), np.concatenate((ids.take(row + np.minimum(k, size - 1)), ids.take(here))))
        own, left = np.where(k < end, rank[: len(live)], -1), rank[len(live) :]
        of = live * (2 * size)
        leaf = of + size
        tree[leaf + j] = none
        tree[leaf + i] = np.where(own >= 0, own << bits | i, none)
        tree[leaf + q] = np.where(p >= 0, np.where(left >= 0, left << bits | q, none), tree.take(leaf + q))
        node, of = np.concatenate((size + i, size + j, size + q)) >> 1, np.concatenate((of, of, of))
        while node[0]:
            child = of + 2 * node
            tree[of + node] = np.minimum(tree.take(child), tree.take(child + 1))
            node >>= 1
    ids, start = ids.reshape(m, size), start.reshape(m, size)

    packed, ends = ids[start].astype("<u4").tobytes(), (4 * start.sum(axis=1).cumsum()).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes text to ids, packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.pieces, self.plain = regex.compile(pattern), pattern == SPLIT_PATTERN
        self.tokens = {i: token for token, i in ranks.items()}
        #: Of a word without the space before it, and of one with it; "" is the word of no text.
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.by_piece: dict[str, bytes] = {}

    def _learn(self, words: list[str], lead: str, known: dict[str, bytes], all_alone: bool) -> set[str]:
        """Puts the ids of these words into ``known``; returns those that next to others may be cut otherwise.

        These are left out, unless ``all_alone``.
        """
        odd, cuts, pieces = set(), [], set()
        for word in words:
            if m := _PLAIN.fullmatch(word):
                cut = (lead + m[1], m[2]) if m[2] else (lead + word,)
            elif lead and (not word or word[0].isspace()) or word[-1:].isspace():
                odd.add(word)
                if not all_alone:
                    continue
                cut = self.pieces.findall(lead + word)
            else:
                cut = self.pieces.findall(lead + word)
            cuts.append((word, cut))
            pieces.update(cut)
        self._merge(pieces.difference(self.by_piece))
        get, join = self.by_piece.__getitem__, b"".join
        for word, cut in cuts:
            known[word] = get(cut[0]) if len(cut) == 1 else join(map(get, cut))
        return odd

    def _merge(self, pieces: set[str]) -> None:
        """Puts the ids of these pieces into ``by_piece``."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        known, whole = self.by_piece, self.ranks.get
        for piece in pieces:
            raw = piece.encode()
            if (rank := whole(raw)) is not None:
                known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > TOGETHER:
                ids = merge(raw, self.ranks)
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                short.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in short.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                known.update(zip((p for p, _ in part), merge_many([raw for _, raw in part], self.ranks, self.pairs)))

    def _cut_alone(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the pattern alone cuts."""
        if len(self.by_piece) > CACHED_PIECES:
            self.by_piece.clear()
        cuts = [[m[0] for m in self.pieces.finditer(text)] for text in texts]
        self._merge({p for cut in cuts for p in cut if p}.difference(self.by_piece))
        out = [b"".join(self.by_piece[p] for p in cut if p) for cut in cuts]
        for key in [k for k in self.by_piece if len(k) > CACHED_CHARS]:
            del self.by_piece[key]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._cut_alone(texts)
        splits = [text.split(" ") for text in texts]
        for cache, most in ((self.by_piece, CACHED_PIECES), (self.words[0], CACHED_WORDS // 10), (self.words[1], CACHED_WORDS)):
            if len(cache) > most:
                cache.clear()
        odd: set[str] = set()
        for again in (False, True):
            for lead, known, words in (("", self.words[0], {s[0] for s in splits}), (" ", self.words[1], set().union(*(s[1:] for s in splits)))):
                odd |= self._learn([w for w in words if w not in known], lead, known, again)
            if not odd:
                break
            if not again:
                splits = [_BETWEEN.split(text) if not odd.isdisjoint(s) else s for text, s in zip(texts, splits)]
        first, later, join = self.words[0], self.words[1].__getitem__, b"".join
        out = [first[s[0]] + join(map(later, s[1:])) for s in splits]
        for cache in (self.by_piece, *self.words):
            for key in [k for k in cache if len(k) > CACHED_CHARS]:
                del cache[key]
        for known in self.words:  # they hold for this split only
            for word in odd:
                known.pop(word, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, read once by each Python worker."""
    claim("bpe")
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of the whole text as a binary of little-endian unsigned 32-bit integers.

    No shuffle: each row is encoded where it is read. ``ranks_path`` must be readable on every executor, as an
    installed package is.
    """

    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(_encoded(codec(ranks_path, pattern), texts), pa.binary())

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for (null ids: no bytes)."""

    @F.arrow_udf("binary")
    def raw(packed: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        return pa.array((c.decode(p.as_py() or b"") for p in packed), pa.binary(), size=len(packed))

    return df.withColumn(out, raw(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of the text, and the bytes decoded from these ids.

    Both come from one worker: as two functions, Spark would encode twice, or hold two workers a task.
    """

    bounded_batches(df.sparkSession)

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        packed = _encoded(c, texts)
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(map(c.decode, packed), pa.binary(), size=len(packed))], names=["ids", "decoded"])

    h = fresh(df, "both")
    return df.withColumn(h, both(F.col(text))).withColumns({ids: F.col(h).ids, decoded: F.col(h).decoded}).drop(h)


def _encoded(c: Codec, texts: pa.Array) -> list[bytes]:
    out, part, chars = [], [], 0
    for t in texts:
        part.append(t.as_py() or "")
        chars += len(part[-1])
        if chars >= BATCH_CHARS:
            out += c.encode_batch(part)
            part, chars = [], 0
    return out + c.encode_batch(part)


def id_array(packed: str) -> object:
    """Packed ids as an ``array<long>`` column, JVM-side."""
    h = F.hex(F.col(packed))
    n = (F.octet_length(F.col(packed)) / 4).cast("int")
    octet = lambda i, k: F.substring(h, i * 8 + (2 * k + 1), F.lit(2))
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.concat(*(octet(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long"))
    )
