"""The n-gram join against brute force: sets, links, components, hot groups, and each part of it."""

import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import components, ngram_join
from leafmill.llm.ngram_join import Threshold


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c == " " or "\t" <= c <= "\r":
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + ([word] if word else [])


def plain_set(text, n):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    """component_id of each id."""
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, plain_set(t, n)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    least = {}
    for i in up:
        least[root(i)] = min(i, least.get(root(i), i))
    return {i: least[root(i)] for i in up}


def edited(words, share, pick):
    return [pick.choice("qwertyuiop") * 3 + str(pick.random()) if pick.random() < share else w for w in words]


def corpus(seed, docs=160):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = pick.choices(vocabulary, k=60)
    rows = []
    while len(rows) < docs:
        base = pick.choices(vocabulary, k=pick.choice([1, 2, 3, 4, 5, 8, 14, 30, 90, 300, 900]))
        if pick.random() < 0.3:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(pick.choice([1, 1, 1, 2, 5, 20])):
            rows.append(" ".join(edited(base, pick.choice([0, 0, 0.002, 0.01, 0.02, 0.04, 0.08]), pick)))
    hot = pick.choices(vocabulary, k=120)
    rows += [" ".join(edited(hot, pick.choice([0.005, 0.01, 0.02, 0.03]), pick)) for _ in range(80)] + [" ".join(hot).upper()] * 60
    rows += [None, None, "", " \t\n", "one", "ONE", "one two", "é x y z", "a\x1cb c d e"]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n, num, den, block", [(4, 85, 100, 512), (5, 80, 100, 16)])
def test_components_against_brute_force(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(n)
    df = spark.createDataFrame([(i, t, i, 1) for i, t in rows] + [(None, "w1 w2 w3 w4 w5", 0, 1), (None, None, 0, 1)], "doc_id long, text string, node long, component_id int").repartition(6)
    got = ngram_join.jaccard_components(df, n, num, den).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows, n, num, den)
    assert len(set(want.values())) < len(rows) - 100
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {i: len(plain_set(t, n)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (7, text + " end"), (5, "other words than these are"), (9, "other words than these are"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 4, 85, 100).collect())
    assert got == Counter([(5, 47, 5), (5, 47, 5), (7, 48, 5), (5, 2, 5), (9, 2, 5), (3, 0, 3)])
    for empty in (df.limit(0), df.where("doc_id = 3")):
        assert ngram_join.jaccard_components(empty, 4, 85, 100).count() == empty.count()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([(85, 100), (80, 100), (1, 1), (50, 100)]))
def test_linked_sets_share_a_key(seed, size, share):
    t, random_ = Threshold(*share), np.random.Generator(np.random.PCG64(seed))
    a = np.unique(random_.integers(0, 1 << 64, size, dtype=np.uint64))
    for swaps in range(0, size // 2 + 2):
        b = np.unique(np.r_[a[swaps // 2 :], random_.integers(0, 1 << 64, swaps - swaps // 2, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if not t.linked(len(a), len(b), both):
            continue
        if not np.array_equal(a, b):
            found = [ngram_join.keys(x, t) for x in (a, b)]
            assert np.intersect1d(*found).size
            # also when both leave out what is frequent, whatever keys that is
            for share in (0.3, 0.9, 1.0):
                every = np.unique(np.concatenate(found))
                times = np.where(random_.random(len(every)) < share, random_.integers(1, 4, len(every)), 0)
                kept = [k[ngram_join.leave_out(k, len(x), times[np.searchsorted(every, k)], t)] for k, x in zip(found, (a, b))]
                assert np.intersect1d(*kept).size


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 40), st.sampled_from([(85, 100), (60, 100)]))
def test_trees_miss_no_link(seed, n, m, share):
    t, pick = Threshold(*share), np.random.Generator(np.random.PCG64(seed))
    base = pick.integers(0, 1 << 64, 60, dtype=np.uint64)

    def some():
        keep = base[pick.random(60) > pick.choice([0, 0.02, 0.1, 0.3])]
        return np.unique(np.r_[keep, pick.integers(0, 1 << 64, int(pick.integers(0, 12)), dtype=np.uint64), base[:1]])

    one, other = [some() for _ in range(n)], [some() for _ in range(m)]
    linked = lambda u, v: t.linked(len(u), len(v), len(np.intersect1d(u, v)))

    def groups(size, pairs):
        forest = ngram_join.Forest(size)
        for a, b in pairs:
            forest.up[forest.root(a)] = forest.root(b)
        least: dict = {}
        return [least.setdefault(forest.root(i), i) for i in range(size)]

    got = ngram_join.links(one, None, t)
    assert all(linked(one[a], one[b]) for a, b in got) and len(got) < max(1, n)
    assert groups(n, got) == groups(n, [(i, j) for i, j in combinations(range(n), 2) if linked(one[i], one[j])])
    if other:
        got = ngram_join.links(one, other, t)
        assert groups(n + m, got) == groups(n + m, [(i, n + j) for i in range(n) for j in range(m) if linked(one[i], other[j])])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 40), st.sampled_from([(85, 100), (60, 100), (20, 100)]))
def test_bitmaps_leave_linked_sets_a_partner(seed, n, m, share):
    t, pick = Threshold(*share), np.random.Generator(np.random.PCG64(seed))
    # sizes on both sides of a step of the bitmaps' width
    base = pick.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[base[pick.random(300) > pick.choice([0.02, 0.1, 0.3, 0.8])], pick.integers(0, 1 << 64, int(pick.integers(0, 60)), dtype=np.uint64), base[:1]]) for _ in range(n + m)]
    roots = pick.integers(0, max(2, n // 2), n + m).tolist()
    members = [(ngram_join.bitmap(s, ngram_join.width(len(s), ngram_join.BITS_SENT)), len(s), r) for s, r in zip(sets, roots)]
    linked = lambda i, j: roots[i] != roots[j] and t.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))
    stay = ngram_join.partnered(members[:n], None, t)
    assert all(stay[i] and stay[j] for i, j in combinations(range(n), 2) if linked(i, j))
    if m:
        stay = ngram_join.partnered(members[:n], members[n:], t)
        assert len(stay) == n + m
        assert all(stay[i] and stay[j] for i in range(n) for j in range(n, n + m) if linked(i, j))


def test_bitmaps_rule_out_sets_that_share_a_passage():
    t, pick = Threshold(80, 100), np.random.Generator(np.random.PCG64(1))
    passage = pick.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, pick.integers(0, 1 << 64, 200 + 2 * k, dtype=np.uint64)]) for k in range(30)]
    members = [(ngram_join.bitmap(s, ngram_join.width(len(s), ngram_join.BITS_SENT)), len(s), k) for k, s in enumerate(sets)]
    assert not ngram_join.partnered(members, None, t).any()


def test_meeting_sets_take_little_memory():
    """Two full parts of sets with a common passage: none is ruled out by a node, so all pairs of bitmaps are looked at."""
    t, pick = Threshold(4, 5), np.random.default_rng(4)
    draw = lambda n: pick.integers(0, 1 << 64, n, dtype=np.uint64)
    common = draw(600)
    one = [np.unique(np.r_[common, draw(400)]) for _ in range(ngram_join.BLOCK)]
    other = [np.unique(np.r_[s[:-20], draw(20)]) for s in one]
    bits = ngram_join.width(1000, ngram_join.BITS_SENT)
    members = [(ngram_join.bitmap(s, bits), len(s), i) for i, s in enumerate(one + other)]
    for meet in (lambda: ngram_join.links(one, other, t), lambda: ngram_join.partnered(members[: len(one)], members[len(one) :], t)):
        tracemalloc.start()
        try:
            found, most = meet(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert most < 64 << 20
        if isinstance(found, list):
            assert {(a, a + len(one)) for a in range(len(one))} == set(found)
        else:
            assert found.all()


def test_components_of_paths_stars_and_loops(spark):
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(1, 2), (2, 1), (2, 3), (3, 1), (50, 50)]
    edges += [(pick.randrange(2000, 2100), pick.randrange(2000, 2100)) for _ in range(90)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len(up) and {r.node: r.component for r in got} == up
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("whole, times", [(16, 64), (16, 0), (512, 64)])
def test_large_clusters_against_brute_force(spark, monkeypatch, whole, times):
    """Near copies in a chain and a common passage make clusters of many parts, components of many tasks, and keys over a block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "WHOLE", whole)
    monkeypatch.setattr(ngram_join, "COPIES", times)
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 128)
    pick = random.Random(5)
    words, rows = [f"v{i}" for i in range(5000)], []
    passage = pick.choices(words, k=60)
    text = pick.choices(words, k=90)
    for _ in range(60):  # each is linked with its neighbours only
        text = text[3:] + pick.choices(words, k=3)
        rows.append(" ".join(text))
    for _ in range(50):
        rows.append(" ".join(passage + pick.choices(words, k=14 + pick.randrange(3))))
    base = pick.choices(words, k=100)
    rows += [" ".join(edited(base, 0.02, pick)) for _ in range(120)]
    pick.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)
