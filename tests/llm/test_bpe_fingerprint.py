"""Byte-level BPE against tiktoken, and fingerprints against a plain version of their definition."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe, fingerprint, queries

RANKS = bpe.read_ranks(queries.VOCABULARY)
CODEC = bpe.codec(queries.VOCABULARY, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SOME = "ab  \n\t'sdtreLLE1２½²é中\x1c\x85​　.,!?#\U0001f600́ſ"


def ids(packed):
    return memoryview(packed).cast("I").tolist() if packed else []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.sampled_from(SOME), max_size=40), st.text(max_size=40)))
def test_encodes_like_tiktoken_and_decodes(text):
    text = text.encode("utf-8", "ignore").decode()
    packed = CODEC.encode(text)
    assert ids(packed) == THEIRS.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 777 + "x", " ".join(["é"] * 999), "<|endoftext|>", "x" * 65, "don't we'll I'VE"])
def test_long_runs(text):
    assert ids(CODEC.encode(text)) == THEIRS.encode_ordinary(text)


def test_merges_alike_one_by_one_and_together():
    pieces = [bytes(random.Random(i).choices(b"theraton ing", k=2 + i % 40)) for i in range(300)]
    together = {}
    for n in {(len(p) - 1).bit_length() for p in pieces}:
        group = [p for p in pieces if (len(p) - 1).bit_length() == n]
        together |= dict(zip(group, bpe.merge_many(group, RANKS, CODEC.pairs)))
    assert all(ids(together[p]) == bpe.merge(p, RANKS) for p in pieces)


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    c = bpe.Codec(RANKS, P.PATTERN)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(20)) + " " + "q" * 200
        assert ids(c.encode(text)) == THEIRS.encode_ordinary(text)
        assert len(c.words[1]) <= 50 + 25 and all(len(k) <= bpe.CACHED_CHARS for k in c.words[1])


def test_columns_and_nulls(spark):
    rows = [(1, "héllo wörld", "kept"), (2, None, None), (3, "", "x"), (1, "héllo wörld", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, queries.VOCABULARY, P.PATTERN), queries.VOCABULARY, P.PATTERN).withColumn("list", bpe.id_array("ids"))
    got = sorted((r.doc_id, bytes(r.decoded).decode(), list(r.list)) for r in out.collect())
    assert got == sorted((i, t or "", THEIRS.encode_ordinary(t or "")) for i, t, _ in rows)
    both = bpe.round_trip(df.limit(0), queries.VOCABULARY, P.PATTERN)
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and both.count() == 0


def test_op1_query(spark, tmp_path):
    texts = ["One two  three\n\nfour", None, "", "a" * 3000, "über 12345 naïve!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op1_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        want = THEIRS.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in want)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# fingerprints


def plain_fingerprint(text):
    """Byte by byte, as the definition says."""
    data = text.encode()
    hashes = []
    for i in range(len(data)):
        window = [data[i - k] if i >= k else 0 for k in range(7)]
        mixed = 0
        for k, c in enumerate(window):
            mixed ^= (c << 5 * k) & 0xFFFFFFFF if 5 * k < 32 else 0
        hashes.append((sum(c * (7 - k + 1) for k, c in enumerate(window)) + mixed) & 0xFFFFFFFF)

    def symbols(size):
        parts, start = [], 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and len(parts) < 63:
                parts.append(data[start : i + 1])
                start = i + 1
        if start < len(data):
            parts.append(data[start:])
        return parts

    import zlib

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(h % size == size - 1 for h in hashes) + 1 < 32:
        size //= 2
    show = lambda parts: "".join(fingerprint._SYMBOLS[zlib.crc32(p) & 0xFFF] for p in parts)
    return f"{size}:{show(symbols(size))}:{show(symbols(2 * size))}"


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcdé \n"), max_size=600))
def test_fingerprint_is_as_defined(text):
    assert fingerprint.fingerprint_text(text) == plain_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(*[st.lists(st.sampled_from(["AA", "AB", "zz", "9+"]), max_size=30)] * 2)
def test_common_symbols_by_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fingerprint.common_symbols("".join(a), "".join(b)) == table[-1][-1]


def test_edits_against_brute_force(spark):
    word = random.Random(5)
    text = lambda n: " ".join("".join(word.choices("abcdefghij", k=5)) for _ in range(n))
    rows = [(i, text(n)) for i, n in enumerate([0, 1, 3, 40, 200, 900, 60, 60])] + [(20, None), (None, text(30)), (21, "same"), (21, "same"), (-5, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follows[:cut]
        a, b, c = (plain_fingerprint(x) for x in (t, edited, follows))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.compare(a, b), fingerprint.compare(a, c)))
    got = [tuple(r) for r in fingerprint.fingerprint_edits(df).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert fingerprint.fingerprint_edits(df.limit(0)).count() == 0
    assert fingerprint.fingerprint_edits(spark.createDataFrame(rows[3:4], "doc_id long, text string")).count() == 1


def test_near_edits_are_near_and_others_far():
    word = random.Random(9)
    text = lambda: " ".join("".join(word.choices("abcdefghijklmnop", k=6)) for _ in range(400))
    a, b = text(), text()
    near = fingerprint.compare(*map(fingerprint.fingerprint_text, (a, a[: len(a) * 3 // 4] + b[: len(a) // 4])))
    far = fingerprint.compare(*map(fingerprint.fingerprint_text, (a, b)))
    assert near > 0.6 and far < 0.1


def test_texts_that_repeat_a_passage_are_fingerprinted_whole():
    for seed in (1, 2, 3, 4):
        word = random.Random(seed)
        some = lambda n: "".join(word.choices("abcdefghijklmnop ", k=n))
        passage, other = some(416), some(416)
        for times in (300, 2000, 2600):
            text = passage * times
            found = fingerprint.fingerprint_text(text)
            assert all(len(s) <= 2 * fingerprint.KEPT for s in found.split(":")[1:])
            changes = [fingerprint.compare(found, fingerprint.fingerprint_text(text[: len(text) * k // 4] + (other * times)[: len(text) - len(text) * k // 4])) for k in (1, 2, 3)]
            # the edit's share shows, wherever the texts have a common block size
            assert changes[0] < 0.6 and changes[1] < 0.8 and changes[2] < 0.95, (seed, times, changes)
            tail = text[: len(text) // 2] + "".join(c if i % 416 else "Z" for i, c in enumerate(text[len(text) // 2 :]))
            assert fingerprint.compare(found, fingerprint.fingerprint_text(tail)) < 0.9


def test_only_a_short_rest_is_one_symbol():
    word = random.Random(11)
    over = 0
    for _ in range(60):
        data = "".join(word.choices("abcdefghijklmnop ", k=6100)).encode()
        hashes = fingerprint.rolling(memoryview(data))
        size, narrow, _ = fingerprint.signature(data, hashes).split(":")
        ends = [i + 1 for i, h in enumerate(hashes.tolist()) if h % int(size) == int(size) - 1]
        assert len(ends) < 64 or len(data) - ends[62] <= 4 * int(size) or len(narrow) // 2 == len(ends) + (ends[-1] < len(data))
        over += int(size) > 96
    assert over
