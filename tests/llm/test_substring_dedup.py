"""Seed and extend against a dictionary of all windows."""

import hashlib
import random

import pytest

from tidewave.llm import substring_dedup


def brute(texts):
    first, words = {}, [(t or "").split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["da", "di", "do"]) + rng.choice("abcde")
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    texts = []
    for _ in range(60):
        parts = [[word() for _ in range(rng.randint(0, 15))] for _ in range(3)]
        texts.append(" \n".join(" ".join(p) for x in parts for p in (x, rng.choice(passages))))
    return texts + [texts[3], texts[3].replace("\n", "\t"), "", None, "short one", "short one", "éà " * 14, "éà " * 14]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    texts = corpus(seed)
    words, kept = brute(texts)
    got = {r.doc_id: r for r in substring_dedup.repeat_digests(documents(texts)).collect()}
    for d in range(len(texts)):
        assert (got[d].n_words, got[d].n_removed) == (len(words[d]), len(words[d]) - len(kept[d])), d
        assert got[d].kept_sha256 == hashlib.sha256(" ".join(kept[d]).encode()).hexdigest()


def test_strip_keeps_columns_and_clean_texts(spark):
    texts = corpus(3)
    words, kept = brute(texts)
    d = spark.createDataFrame([(i, t, "s", "clash", i) for i, t in enumerate(texts)] + [(None, texts[0], "s", "c", 1)], "doc_id long, text string, source string, spans string, h long")
    got = {r.doc_id: r for r in substring_dedup.strip_repeats(d).collect()}
    assert got[None].text == texts[0]
    for i, t in enumerate(texts):
        if words[i] and not kept[i]:
            assert i not in got
        elif len(words[i]) == len(kept[i]):
            assert got[i].text == t
        else:
            assert got[i].text == " ".join(kept[i])
        assert i not in got or (got[i].spans, got[i].h) == ("clash", i)


def test_empty_and_repeated_rows(spark, documents):
    assert substring_dedup.repeat_digests(documents([])).count() == 0
    w = " ".join("abcdefghijklmno")
    d = spark.createDataFrame([(4, w), (4, w), (None, w)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeat_digests(d).collect()] == [0, 0, 0]


def test_maximal_repeats_are_matches_that_do_not_go_on(documents, scratch):
    from pyspark.sql import functions as F

    texts = [t or "" for t in corpus(4)]
    source = documents(texts).select("doc_id", F.xxhash64("text").alias("h"), "text")
    got = substring_dedup.maximal_repeats(source, scratch).collect()
    w = [t.split() for t in texts]
    assert got and len({(r.doc_id, r.start, r.n, r.source, r.source_start) for r in got}) == len(got)
    for r in got:
        assert r.n >= 13 and r.source < r.doc_id
        assert w[r.doc_id][r.start : r.start + r.n] == w[r.source][r.source_start : r.source_start + r.n]


def test_seeds_of_one_hash_but_other_words_are_told_apart():
    import pyarrow as pa

    a, b = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13))
    cols = {"anchor": [9, 9, 9], "doc_id": [5, 5, 5], "h": [1, 1, 1], "place": [3, 3, 3], "left": [3, 3, 2], "ws": [b, a, a.replace("a12", "x")], "source": [2, 2, 2], "source_place": [3, 3, 3], "source_left": [3, 3, 3], "source_ws": [a] * 3}
    (got,) = substring_dedup._matches([pa.RecordBatch.from_pydict(cols)])
    assert got.column("source").to_pylist() == [None, 2, None]
    assert got.column("ws").to_pylist() == [b, None, a.replace("a12", "x")]
    wide = "p q r s t u " + a + " v w x y z"  # 12 windows; the source has those from r to z
    cols = {k: v[:1] for k, v in cols.items()} | {"place": [9], "left": [9], "ws": [wide], "source_left": [7], "source_ws": ["r s t u " + a + " v w other"]}
    (got,) = substring_dedup._matches([pa.RecordBatch.from_pydict(cols)])
    assert got.num_rows and set(got.column("source").to_pylist()) == {None, 2}
    for r in got.to_pylist():
        if r["source"] is None:
            assert wide.split()[9 - r["left"] :][: len(r["ws"].split())] == r["ws"].split()


def test_a_very_common_passage_and_a_very_long_text(documents):
    common = " ".join(f"c{i}" for i in range(20))
    texts = [f"{common} own{i}" for i in range(400)] + [" ".join(f"w{i % 5000}" for i in range(60_000)), f"x{'y' * 200_000} {common}"]
    words, kept = brute(texts)
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeat_digests(documents(texts)).collect()}
    assert got == {d: len(words[d]) - len(kept[d]) for d in range(len(texts))}


def test_rows_alike_are_matched_at_once(monkeypatch):
    import pyarrow as pa

    a, other = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(13))
    cols = {"anchor": [9] * 4, "doc_id": [5, 2, 6, 7], "h": [1, 2, 3, 4], "place": [30, 3, 8, 3], "left": [4] * 4, "ws": [a, a, a, other], "source": [2] * 4, "source_place": [10] * 4, "source_left": [4] * 4, "source_ws": [a, a, None, a]}
    extend, asked = substring_dedup.extend, []
    monkeypatch.setattr(substring_dedup, "extend", lambda own, *rest: asked.append(own) or extend(own, *rest))
    (got,) = substring_dedup._matches([pa.RecordBatch.from_pydict(cols)])
    assert [(r["doc_id"], r["h"], r["start"], r["n"], r["source"], r["source_start"]) for r in got.to_pylist() if r["source"] is not None] == [(5, 1, 26, 14, 2, 6), (6, 3, 4, 14, 2, 6)]
    assert {r["doc_id"] for r in got.to_pylist() if r["source"] is None} == {7} and got.schema.names == substring_dedup.MATCHES.names
    assert asked == [other.split()]
    (none,) = substring_dedup._matches([pa.RecordBatch.from_pydict({k: v[1:2] for k, v in cols.items()})])
    assert none.num_rows == 0


def test_anchors_hash_no_whole_windows(monkeypatch):
    import pyarrow as pa

    windows, asked = substring_dedup.windows, []
    monkeypatch.setattr(substring_dedup, "windows", lambda w, k: asked.append(k) or windows(w, k))
    for texts in ([], [""], ["a b c"], [" ".join("abcdefghijkl")], [" ".join("abcdefghijklm"), "x"], ["x", " ".join("abcdefghijklmno")]):
        w = substring_dedup.words(pa.array(texts, pa.string()))
        _, at, low, high = substring_dedup.anchored(w)
        assert sorted(x for a, z in zip(low, high, strict=True) for x in range(a, z + 1)) == windows(w, 13)[1].tolist()
        assert all(z <= x <= a + 6 for x, a, z in zip(at, low, high, strict=True))
    assert set(asked) == {7}
