"""Sharding laws, and mixing against targets and a plain solution of the dual."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing, sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash_one_by_one(n):
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 500, dtype=np.uint64)
    assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards_laws(spark):
    rows = [(i % 900 if i % 3 else 7, "x" * (i % 50) + "é" if i % 11 else None, i) for i in range(1500)] + [(None, "a", 1), (None, None, 2)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard long"), 24).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_targets(sizes, weights, cap):
    """Shares by weight, the excess over the cap dealt anew until none is over."""
    left, open_, out = float(sum(sizes)), {i for i, s in enumerate(sizes) if s}, [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / whole > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= over
    return out


@pytest.mark.parametrize("cap", [1, 2, 3])
def test_targets_share_what_is_over(spark, cap):
    random = np.random.Generator(np.random.PCG64(cap))
    for sizes in ([10, 1000, 0, 500], [0, 0], [], random.integers(0, 900, 40).tolist(), [int(1.5**k) for k in range(30)]):
        names = [f"s{k:02d}" for k in range(len(sizes))]
        rows = [(n if k else None, size, 1) for k, (n, size) in enumerate(zip(names, sizes))]
        histogram = spark.createDataFrame(rows, "source string, size long, n long").repartition(3)
        got = {r.source: r for r in mixing.with_targets(mixing.ranked_sources(histogram, mixing.WEIGHTS), cap).collect()}
        order = [*names[1:], None][: len(sizes)]
        in_order = [*sizes[1:], *sizes[:1]]
        want = plain_targets(in_order, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))], cap)
        assert [got[n].k for n in order] == list(range(len(sizes)))
        assert [got[n].target for n in order] == pytest.approx(want)


def plain_lambda(sizes, target, cap):
    """Bisection on the dual's derivative."""
    mean = sizes.mean()
    low, high = -2000.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (sizes * np.minimum(cap, np.exp(np.minimum(mid * sizes / mean, 5)))).sum() < target else (low, mid)
    return low


def make_docs(spark):
    random = np.random.Generator(np.random.PCG64(4))
    rows, i = [], 0
    for source, n, mean in (("a", 400, 30), ("b", 300, 80), ("b2", 5, 3), (None, 200, 20), ("é", 150, 60)):
        for _ in range(n):
            rows.append((i, source, "w " * int(random.exponential(mean) + 1), 1))
            i += 1
    rows += [(i, "a", None, 1), (i + 1, "zero", "", 1), (None, "a", "x y", 1), (3, "a", "x y z", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, target long")


def test_mix_meets_targets(spark):
    rows, df = make_docs(spark)
    out = mixing.mix(df.repartition(3)).collect()
    assert len(out) == len(rows)
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size and abs(r.copies - r.rate) < 1 for r in out)
    by = defaultdict(list)
    source = {r[0]: r[1] for r in rows}
    for r in out:
        by[source[r.doc_id]].append(r)
    for group in by.values():
        assert len({(r.source_size, round(r.target, 6)) for r in group}) == 1
        assert sum(r.size for r in group) == group[0].source_size
        assert sum(r.taken for r in group) == pytest.approx(group[0].target, abs=max(10, 0.02 * group[0].target))
    sizes = np.array([r.size for r in by["a"] if r.size], float)
    mean = sum(r.size for r in by["a"]) / len(by["a"])
    lam = plain_lambda(sizes, by["a"][0].target, 3.0) * mean / sizes.mean()
    assert all(r.rate == pytest.approx(min(3, np.exp(lam * r.size / mean)), rel=1e-4) for r in by["a"] if r.size)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in out)


def test_mixed_documents_and_empty(spark):
    rows, df = make_docs(spark)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    taken = {(r.doc_id, r.size): 0 for r in mixing.mix(df).collect()}
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect())
    assert all(got[k] == n for k, n in taken.items())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_rounding_follows_rates():
    rate, size = np.array([0.5] * 10 + [2.3] * 7), np.array([9] * 10 + [4] * 7)
    copies, owed = mixing.round_copies(rate, size)
    assert owed == pytest.approx((rate * size).sum() - (copies * size).sum())
    first, carried = mixing.round_copies(rate[:5], size[:5])
    assert np.r_[first, mixing.round_copies(rate[5:], size[5:], carried)[0]].tolist() == copies.tolist()
    assert set(copies[:10]) <= {0, 1} and set(copies[10:]) <= {2, 3}
    assert abs((copies * size).sum() - (rate * size).sum()) <= 4


BIG = [9007199254740993, None, 5, 9007199254740995]


def test_ids_stay_whole_beside_nulls(spark):
    """No id turns into a floating-point number because another one is null."""
    rows = [(i, f"w{n} x y", "en", "s", 3, 1, 2, 3) for n, i in enumerate(BIG)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, key int, of int, copy int").coalesce(1)
    assert {r.doc_id for r in mixing.mix(df).collect()} == set(BIG)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= set(BIG)
    assert sum(r.copies for r in mixing.mix(df).collect()) == mixed.count() > 0
    assert {r.doc_id for r in sharding.shard_documents(df).collect()} == set(BIG)


def test_repeated_ids_share_their_copies_in_one_order(spark):
    rows = [(1, f"a b c {n}", "s" if n % 2 else None, n) for n in range(9)] + [(2, "a b " * 30, "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, nth int")
    first = Counter(map(tuple, mixing.mixed_documents(df.repartition(2)).collect()))
    assert first == Counter(map(tuple, mixing.mixed_documents(df.repartition(5, "nth")).collect()))


def test_slots_of_hot_rows_are_split(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("chunk"), F.lit(0).alias("shard"), F.lit("x").alias("rank"))
    got = sharding.number_slots(rows, ["chunk"], chunks=8)
    assert got.columns == ["chunk", "shard", "rank", "slot"]
    assert sorted(r.slot for r in got.collect()) == list(range(4000))
