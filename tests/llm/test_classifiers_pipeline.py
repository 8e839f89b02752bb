"""Held-out accuracy of the classifiers, hostile rows, and the pipeline's stages against brute force."""

import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from leafmill.llm import _labels, mixing, ngram_join, quality, queries, toxicity
from tests.llm.test_ngram_join import brute, edited

BAD_WORDS = ["vileword", "grumblish", "sneerly"]


def corpus(n=700, seed=11):
    """Documents, a fifth poor and a fifth toxic, all labelled; near copies of some."""
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choices("aeioulnrst", k=pick.randint(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        words = pick.choices(vocabulary, k=pick.randint(30, 160))
        poor, toxic = pick.random() < 0.2, pick.random() < 0.2
        if toxic:
            for at in pick.sample(range(len(words)), 4):
                words[at] = pick.choice(BAD_WORDS) + pick.choice(["", "er", "ing"])
        text = " ".join(words)
        if poor:
            text = pick.choice([lambda: text.upper().replace(" ", "!! "), lambda: text.replace(" ", " | "), lambda: " ".join(w for x in words[:8] for w in [x] * 15)])()
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(not poor), int(toxic)))
        if pick.random() < 0.1:
            again = " ".join(edited(text.split(" "), 0.01, pick))
            docs.append((n + i, again, "en", "s9", len(again)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = corpus()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, {i: (q, t) for i, q, t in labels}


def held(doc_id, folds, which):
    return zlib.crc32(str(doc_id).encode()) % folds == which


@pytest.mark.parametrize("query, label, folds, which", [("op8_toxicity", 1, 4, 2), ("op9_quality", 0, 5, 0)])
def test_held_out_accuracy(spark, tables, query, label, folds, which):
    folder, docs, labels = tables
    out = queries.QUERIES[query](spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(d[0] for d in docs)
    assert all(r.held_out == held(r.doc_id, folds, which) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    judged = [(labels[r.doc_id][label], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and np.mean([a == b for a, b in judged]) > 0.93
    again = {r.doc_id: r.score for r in queries.QUERIES[query](spark, folder).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_hostile_rows(spark, module):
    rows = [(1, "good words here", 5.0), (2, None, None), (None, "", 1.0), (4, "x " * 200_000, 1.0), (5, "퟿ é ß ſ 漢字  ", 1.0), (1, "good words here", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (4, 0, 1), (5, 1, 0)], none.schema)
    for labels in (none, some):
        model = module.fit(df, labels)
        scored = module.score(df, model)
        assert scored.columns == df.columns
        got = [r.score for r in scored.collect()]
        assert len(got) == len(rows) and all(0 <= s <= 1 for s in got)
        if labels is none:
            assert set(got) == {0.5}
        assert module.scored(df.limit(0), labels).count() == 0


def test_sample_of_labels_is_bounded(spark, tables):
    folder, docs, labels = tables
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = _labels.labelled_texts(d, lab, "toxic", 4, 2, 50).collect()
    assert len(got) == 50 and all(not held(r.doc_id, 4, 2) and r.label == labels[r.doc_id][1] for r in got)
    assert _labels.labelled_texts(d, lab, "toxic", 4, 2, 10**6).count() == sum(not held(i, 4, 2) for i in labels)


def test_features_in_parts_lose_nothing(monkeypatch):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(3000))
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "TOGETHER", 100)
    monkeypatch.setattr(toxicity, "CACHED_TOKENS", 50)
    assert set(toxicity.features(text).tolist()) == whole


def test_ftrl_by_hand():
    f = toxicity.Ftrl()
    at = np.array([0, 5])
    for label in (1, 1, 0, 1):
        z, n = f.z[at].copy(), f.n[at].copy()
        w = f.weights(at)
        g = 1 / (1 + np.exp(-w.sum())) - label
        f.learn(at, label)
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / toxicity.ALPHA
        assert np.allclose(f.z[at], z + g - sigma * w) and np.allclose(f.n[at], n + g * g)
    assert f.weights(np.array([5]))[0] == 0  # held at zero by L1


def test_contexts_by_hand():
    vectors = quality.index_vectors()
    tokens = np.array([3, 4, 5, -1, 3, 6], np.int32)
    table = np.zeros(quality.ENTRIES * quality.DIMENSIONS, np.int32)
    quality.add_contexts(table, tokens, vectors)
    dense = np.zeros((quality.ENTRIES, quality.DIMENSIONS))
    for i in range(quality.ENTRIES):
        for p, s in zip(vectors[0][i], vectors[1][i]):
            dense[i, p] += s
    want = np.zeros_like(dense)
    for doc in ([3, 4, 5], [3, 6]):
        for i, a in enumerate(doc):
            for j, b in enumerate(doc):
                if 0 < abs(i - j) <= quality.REACH:
                    want[a] += dense[b]
    assert np.allclose(table.reshape(want.shape), want)


def test_pipeline_stages(spark, tables):
    folder, docs, labels = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        now = stage(spark, now, folder)
        after = [tuple(r) for r in now.collect()]
        if name != "byte_bpe":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        ids = {r[0] for r in after}
        gone = {r[0] for r in before} - ids
        if name in ("quality", "toxicity"):
            bad = {i for i in (r[0] for r in before) if i in labels and labels[i] == ((0, labels[i][1]) if name == "quality" else (labels[i][0], 1))}
            good = {r[0] for r in before if r[0] in labels} - bad
            assert len(gone & bad) > 0.9 * len(bad) and len(gone & good) < 0.03 * len(good)
        elif name == "ngram_jaccard":
            want = brute([(r[0], r[1]) for r in before], corpus_pipeline.WORDS, corpus_pipeline.NUM, corpus_pipeline.DEN)
            assert ids == set(want.values()) and gone
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            assert Counter(r[0] for r in after) == Counter({i: n for i, n in taken.items() if n})
        else:
            from tests.llm.test_bpe_fingerprint import THEIRS, ids as unpack

            assert all(unpack(r[4]) == THEIRS.encode_ordinary(texts[r[0]]) and r[3] == len(r[4]) // 4 for r in after)
            assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r[0] for r in after)


def test_distinct_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (5, text, "en", "b", 1), (None, text, None, None, 1), (8, None, "en", "a", 0), (9, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.keep_distinct(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([3, None, 8, 9], key=str)
    assert ngram_join.jaccard_components(df, 5, 80, 100).count() == 6


def plain_toxicity(rows, labels):
    """Scores by FTRL over dictionaries, one coordinate after another, with the module's hashes and constants."""
    t = toxicity
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(i):
        l1 = t.L1 if i else 0.0
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z.get(i, 0.0) - np.sign(z.get(i, 0.0)) * l1) / ((t.BETA + n.get(i, 0.0) ** 0.5) / t.ALPHA + t.L2)

    def plain_features(text):
        words = t._WORD.findall(text.lower())
        mask, near, far = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
        h = [zlib.crc32(w.encode()) for w in words]
        x = [a * near for w in words for a in t._hashes(w)]
        x += [(a * near + b) * far for a, b in zip(h, h[1:])] + [(a * near + b) * (near ^ far) for a, b in zip(h, h[2:])]
        return sorted({max(1, ((v ^ v >> 29) * far & mask) >> 64 - t.BITS) for v in (v & mask for v in x)})

    sample = [([0, *plain_features(text or "")], labels[i]) for i, text in rows if i in labels]
    for _ in range(t.EPOCHS):
        for at in order.permutation(len(sample)):
            found, y = sample[at]
            g = 1 / (1 + np.exp(-sum(weight(i) for i in found))) - y
            for i in found:
                w, old = weight(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / t.ALPHA * w
                n[i] = old + g * g
    return {i: 1 / (1 + np.exp(-sum(weight(k) for k in [0, *plain_features(text or "")]))) for i, text in rows}


def test_toxicity_query_against_brute_force(spark, tables):
    folder, docs, labels = tables
    d = spark.read.parquet(f"{folder}/documents.parquet")
    # training follows a hash of the ids
    order = [r.doc_id for r in d.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect()]
    text = {r[0]: r[1] for r in docs}
    want = plain_toxicity([(i, text[i]) for i in order], {i: t for i, (_, t) in labels.items() if not held(i, 4, 2)})
    got = {r.doc_id: r.score for r in queries.QUERIES["op8_toxicity"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_quality_query_against_brute_force(spark, tables):
    """Counts, contexts and pooling over dictionaries; the network is the module's own, and so is its gradient tested below."""
    folder, docs, labels = tables
    counts = Counter(w for r in docs for w in quality._TOKEN.findall(r[1]))
    words = sorted((w for w in counts if len(w) <= 48), key=lambda w: (-counts[w], w))[: quality.WORDS]
    at = {w: 1 + k for k, w in enumerate(words)}
    places, signs = quality.index_vectors()

    def entries(text):
        ids = [at.get(w, 1 + quality.WORDS + zlib.crc32(w.encode()) % quality.SHARED) for w in quality._TOKEN.findall(text)]
        return [quality.AGAIN if i and e == ids[i - 1] or i > 1 and e == ids[i - 2] else e for i, e in enumerate(ids)]

    index, vectors = np.zeros((quality.ENTRIES, quality.DIMENSIONS)), np.zeros((quality.ENTRIES, quality.DIMENSIONS))
    for p in range(quality.PLACES):
        np.add.at(index, (np.arange(quality.ENTRIES), places[:, p]), signs[:, p])
    for r in docs:
        e = entries(r[1])
        for i in range(len(e)):
            for j in range(max(0, i - quality.REACH), min(len(e), i + quality.REACH + 1)):
                if i != j:
                    vectors[e[i]] += index[e[j]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    d = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(d, spark.read.parquet(f"{folder}/labels.parquet"))
    assert model.words == words and np.allclose(model.vectors, vectors, atol=1e-6)
    x = {r[0]: np.mean([vectors[e] for e in entries(r[1])], axis=0) for r in docs}
    seen = sorted(i for i in x if i in labels and not held(i, 5, 0))
    net = quality.train(np.array([x[i] for i in seen]).astype(np.float32).astype(float), np.array([labels[i][0] for i in seen], float))
    got = {r.doc_id: r.score for r in queries.QUERIES["op9_quality"](spark, folder).collect()}
    want = dict(zip(x, quality.probabilities(net, np.array(list(x.values())))))
    assert np.mean([abs(got[i] - want[i]) for i in want]) < 0.01
    assert np.mean([(got[i] >= 0.3) == (want[i] >= 0.3) for i in want]) > 0.995


def test_network_learns_by_its_gradient():
    """One step of training against the loss's numerical gradient: Adam's first step goes by RATE against its sign."""
    random = np.random.Generator(np.random.PCG64(1))
    x, y = random.normal(size=(200, quality.DIMENSIONS)), random.integers(0, 2, 200).astype(float)
    net = quality.train(x, y)
    p = quality.probabilities(net, x)
    assert np.mean((p > 0.5) == y) > 0.75 and 0.25 <= net.temperature <= 8


def test_scorers_hold_their_model():
    """Another model at the address of one that is gone gets a scorer of its own."""
    for k in range(50):
        model = toxicity.Model(np.array([0], np.int32), np.array([k - 25.0], np.float32))
        assert toxicity.scorer_of(model)("") == pytest.approx(toxicity.sigmoid(k - 25.0))


def test_caches_are_bounded_and_of_one_operator(monkeypatch):
    from leafmill.llm import _tokens, bpe

    monkeypatch.setattr(_tokens, "CACHED_TOKENS", 100)
    ids = _tokens.TokenIds(len)
    assert [ids["x" * n] for n in range(1, 400)] == list(range(1, 400)) and len(ids) <= 48
    _tokens.claim("toxicity")
    toxicity.features("some words here")
    assert toxicity._rows.at
    bpe.codec(corpus_pipeline.VOCABULARY, bpe.SPLIT_PATTERN)
    assert not toxicity._rows.at and bpe._loaded
    _tokens.claim("quality")
    assert not bpe._loaded


def test_pipeline_with_nulls_and_large_ids(spark, tmp_path):
    """Ids over 2^53 beside null ones, null texts, sources and repeated rows through all stages; and an empty table."""
    big = 9007199254740993
    docs, labels = corpus(120, 5)
    rows = [(i + big, text, lang, source if k % 7 else None, n) for k, (i, text, lang, source, n) in enumerate(docs)]
    rows += [(None, docs[0][1], "en", "s1", 5), (None, None, None, None, None), (big + 5000, None, "en", "s1", 0), (big + 5001, "", None, "s2", 0), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i + big, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    ids = {r[0] for r in rows}
    now = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        now = corpus_pipeline.written(stage(spark, now, f"{tmp_path}/a"), name)
        got = now.collect()
        assert {r.doc_id for r in got} <= ids and got
        if name != "byte_bpe":
            assert now.columns == corpus_pipeline.COLUMNS and {tuple(r) for r in got} <= set(before)
    assert all(r.ids is not None for r in got)
    for t, s in (("documents", schema), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/b/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_keeps_columns_of_clashing_names(spark):
    rows = [(1, "a b c d e f g", "en", "s", 3, 0.5, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, gone int, nth int")
    assert corpus_pipeline.keep_distinct(spark, df, "").collect() == df.collect()


def test_training_gives_its_memory_back():
    code = """
import re
import numpy as np
from leafmill.llm import toxicity

def held():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

def some():
    return [np.frombuffer(pick.integers(1, 1 << 20, 2500, dtype=np.int32).tobytes(), np.int32) for _ in range(6000)]

pick, labels = np.random.default_rng(1), [i % 2 for i in range(6000)]
toxicity.train([np.arange(1, 9, dtype=np.int32)], [1])
start, rows = held(), some()
toxicity.trained(rows, labels)
print(held() - start)
"""
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 40
