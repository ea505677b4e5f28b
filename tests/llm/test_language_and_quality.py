"""Forward sums against enumeration, and held-out accuracy of both classifiers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import language_id, quality, queries


def test_forward_sums_all_segmentations():
    s = language_id.Scorer(["a", "ab", "b", "ba", "▁", "▁a", "▁ab"])
    p = np.random.default_rng(0).random((8, 2)) / 10
    import pyarrow as pa

    codes, size, which, doc = s.words(pa.array(["abab b", "Bab", None, "", "a☃b"]))
    logs = s.logs(codes, size, p)[which]
    index = {v: i for i, v in enumerate(s.vocabulary)}

    def total(word):
        w = "▁" + word
        out = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[a:b] for a, b in itertools.pairwise(at)]
            if all(q in index for q in parts):
                out += np.prod([p[index[q]] for q in parts], axis=0)
        return np.log(out)

    assert np.allclose(logs, [total(w) for w in ("abab", "b", "bab", "a", "b")])
    assert doc.tolist() == [0, 0, 1, 4, 4]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and len(got) == 1000
    assert got.score.between(0, 1).all()
    q = queries.QUERIES["op3_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = q[q.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((q.score >= 0.3) == (q.predicted == 1)).all()


def test_degenerate(spark, documents):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund ist in dem haus", "de"), (None, "en"), ("x", None)], "text string, lang string")
    m = language_id.train(train)
    d = documents(["the cat", "der hund", None, "", "123 !!", "漢字", "a" * 100_000])
    got = [(r.lang_pred, r.lang_score) for r in language_id.predict(d, m).orderBy("doc_id").collect()]
    assert [x for x, _ in got[:5]] == ["en", "de", "und", "und", "und"] and got[2][1] == 0 and got[5][0] in ("de", "en")
    none = language_id.train(train.where("false"))
    assert {r.lang_pred for r in language_id.predict(d, none).collect()} == {"und"}
    labels = spark.createDataFrame([(0, 1), (9, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    scores = [r.score for r in quality.scored(d, model, ["doc_id"]).collect()]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores)
    assert quality.scored(d, quality.train(d, labels.where("false")), ["doc_id"]).count() == 7
    assert quality.scored(documents([]), model, ["doc_id"]).count() == 0


def test_dual_descent_meets_the_margins():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.choice(50, 8) + (0 if i % 2 else 30)) for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    r = quality.log_ratios(x, y)
    w, b = quality.fit_hinge(x, y, r)
    m = np.array([quality.margin(f, r, w, b) for f in x])
    assert ((m > 0) == (y == 1)).mean() > 0.97
    assert set(quality.features.__code__.co_varnames)  # features are of the text alone


def test_held_out_uses_crc32(spark):
    import zlib

    got = spark.range(40).select("id", language_id.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("n", [0, 1])
def test_features_of_short_texts(n):
    import pyarrow as pa

    assert [len(f) for f in quality.features(pa.array(["x" * n, None]))][1] == 0


def test_long_words_are_summed_whole():
    import pyarrow as pa

    s = language_id.Scorer(["a", "ab", "b", "ba", "bab", "▁", "▁a", "▁ab"])
    p = np.random.default_rng(1).random((9, 3)) / 10
    word = "".join(np.random.default_rng(2).choice(list("abc"), 10_000))
    codes, size, _, _ = s.words(pa.array([word]))
    assert size.tolist() == [10_001]
    index, text = {v: i for i, v in enumerate(s.vocabulary)}, "▁" + word
    logs = np.full((len(text) + 1, 3), -np.inf)
    logs[0] = 0
    for e in range(1, len(text) + 1):
        ways = [logs[e - n] + np.log(p[index[text[e - n : e]]]) for n in (1, 2, 3) if e >= n and text[e - n : e] in index]
        ways += [logs[e - 1] + np.log(p[-1])] if text[e - 1] == "c" else []
        logs[e] = np.logaddexp.reduce(ways, axis=0)
    assert np.allclose(s.logs(codes, size, p)[0], logs[-1], rtol=1e-9)
    # the same words, short enough for both ways
    codes, size, _, _ = s.words(pa.array(["abcab" * 20]))
    assert np.allclose(s.logs(codes, size, p)[0], s.long_logs(codes, p))


def test_expected_uses_equal_enumeration():
    import pyarrow as pa

    s = language_id.Scorer(["a", "ab", "b", "ba", "▁", "▁a", "▁ab"])
    p = np.random.default_rng(0).random((8, 1)) / 10
    codes, size, _, _ = s.words(pa.array(["abab ba"]))
    got = language_id.Lattice(s.trie, codes, size).expected(p, np.array([3.0, 5.0]))
    index, want = {v: i for i, v in enumerate(s.vocabulary)}, np.zeros(7)
    order = ["abab", "ba"] if size.tolist() == [5, 3] else ["ba", "abab"]
    for word, n in zip(order, (3.0, 5.0), strict=True):
        w, ways = "▁" + word, []
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[a:b] for a, b in itertools.pairwise(at)]
            if all(q in index for q in parts):
                ways.append(([index[q] for q in parts], float(np.prod([p[index[q], 0] for q in parts]))))
        for parts, x in ways:
            for q in parts:
                want[q] += n * x / sum(y for _, y in ways)
    assert np.allclose(got, want)


def test_copies_count_once_and_names_clash(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en")] * 300 + [(f"der hund {k} ist in dem haus", "de") for k in range(3)], "text string, lang string")
    m = language_id.train(train, docs_per_language=2)
    assert m.languages == ["de", "en"]
    d = spark.createDataFrame([(1, "the cat", "mine", "own")] * 2, "doc_id long, text string, lang_pred string, Lang_Score string")
    got = language_id.predict(d, m)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_score"] and [r.lang_pred for r in got.collect()] == ["en", "en"]
    both = language_id.predict(d, m, names=("p", "s"))
    assert [(r.lang_pred, r.Lang_Score, r.p) for r in both.collect()] == [("mine", "own", "en")] * 2


def plain_features(text):
    """The hashed n-grams of bytes and word shapes, one by one."""
    import re

    data = (text or "").encode()
    mask = 2**64 - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    out = set()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i : i + n]:
                h = (h << 8 | b) & mask
            out.add(mix(h) >> 46)
    kind = lambda b: 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 4 if 48 <= b < 58 else 8 if b >= 128 else 16 if 33 <= b < 127 else 0
    shapes, last = [], None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        seen = 0
        for b in w:
            seen |= kind(b)
        shapes.append(seen | kind(w[0]) << 8 | kind(w[-1]) << 16 | min(len(w) // 3, 4) << 24 | (w == last) << 32)
        last = w
    for n in (1, 2, 3, 4):
        for i in range(len(shapes) - n + 1):
            h = 1000 + n
            for x in shapes[i : i + n]:
                h = mix((h + x) & mask)
            out.add(h >> 46)
    return sorted(out)


def test_features_equal_plain_ones():
    import pyarrow as pa

    texts = ["", None, "a", "The the the\tCat-5 é!", "x1 X1 x1\x01 ~~ 漢字 ab", " " * 5, "q" * 30]
    assert [f.tolist() for f in quality.features(pa.array(texts))] == [plain_features(t) for t in texts]


def test_log_ratios_and_hinge_optimum_equal_plain_solvers():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 60)
    x = [np.unique(np.r_[rng.choice(12, 3), rng.choice(4, 2) + (12 if label else 16)]) for label in y]
    ratio = quality.log_ratios(x, y)
    counts = np.ones((2, quality.SIZE))
    for f, label in zip(x, y, strict=True):
        for j in f:
            counts[label, j] += 1
    assert np.allclose(ratio, np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())))
    w, bias = quality.fit_hinge(x, y, ratio, epochs=3000)
    # the dual problem by projected gradient steps on a dense matrix
    dense = np.zeros((60, 21))
    for i, f in enumerate(x):
        dense[i, f] = ratio[f] / np.sqrt(ratio[f] @ ratio[f])
    dense[:, 20] = 1
    z = dense * np.where(y == 1, 1.0, -1.0)[:, None]
    q, alpha = z @ z.T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, quality.COST)
    want = z.T @ alpha
    loss = lambda v: v @ v / 2 + quality.COST * np.maximum(0, 1 - z @ v).sum()
    got = np.r_[w[:20], bias]
    assert loss(got) <= loss(want) * 1.001
    assert np.allclose(z @ got, z @ want, atol=0.02)


def test_conflicting_labels_go_by_majority(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good text here", "bad!! 111"] * 4)], "doc_id long, text string")
    labels = [(i, 1 - i % 2) for i in range(8)]
    noise = [(0, 1), (0, 0), (1, 0), (1, 0), (1, 1), (2, 0)]
    train = lambda rows: quality.train(docs, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, text string"))
    a, b = train(labels), train(labels + noise)
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]
    docs2 = spark.createDataFrame([(0, "good text here", 5, "p")] * 2, "doc_id long, text string, score int, predicted string")
    got = quality.scored(docs2, a, docs2.columns)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 2


def plain_uses(s, codes, p):
    """Expected uses by a lattice of logs, one place after another."""
    n, edges = len(codes), list(zip(*[x.tolist() for x in s.edges(codes)], strict=True))
    into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for a, size, k in edges:
        into[a + size].append((a, k))
        out_of[a].append((a + size, k))
    ahead, behind = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
    for i in range(1, n + 1):
        ahead[i] = np.logaddexp.reduce([ahead[a] + np.log(p[k, 0]) for a, k in into[i]] or [-np.inf])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[b] + np.log(p[k, 0]) for b, k in out_of[i]] or [-np.inf])
    uses = np.zeros(len(p) - 1)
    for a, size, k in edges:
        if k >= 0:
            uses[k] += np.exp(ahead[a] + np.log(p[k, 0]) + behind[a + size] - ahead[n])
    return uses, ahead[n]


@pytest.mark.parametrize("letters", [3, 150, 10_000])
def test_long_words_are_learned_whole(letters):
    import pyarrow as pa

    s = language_id.Scorer(["a", "ab", "b", "ba", "▁", "▁a", "▁ab", "abab"])
    rng = np.random.default_rng(letters)
    word = "".join(rng.choice(["a", "b", "a", "ß"], letters))
    p = rng.random((9, 1)) / 20
    codes = s.words(pa.array([word]))[0]
    uses, total = plain_uses(s, codes, p)
    assert np.allclose(s.long_expected(codes, p, 3.0), 3 * uses, rtol=1e-8)
    assert np.allclose(s.long_logs(codes, p), total)
    if letters <= language_id.LONG:
        assert np.allclose(language_id.Lattice(s.trie, codes, np.array([len(codes)])).expected(p, np.array([3.0])), 3 * uses)


def test_bounds_of_training(spark, monkeypatch):
    # a model of one unbroken word of 10 000 letters a language: cut into parts it would learn starts of words
    train = spark.createDataFrame([("ab" * 5000, "x"), ("cd" * 5000, "y"), ("ab cd", "x")], "text string, lang string")
    m = language_id.train(train)
    mark = m.scorer.vocabulary.index("▁")
    assert m.languages == ["x", "y"] and (m.p[:-1].sum(axis=0) == pytest.approx(1, abs=1e-6))
    assert m.p[mark, 1] < 0.05
    with pytest.raises(ValueError):
        language_id.Scorer(["a" * 65])
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.train(train)
