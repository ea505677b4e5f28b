"""Periodic runs against a search of every period at every place, and the query against a plain reading of its contract."""

import hashlib
import random
import re
import time
import zlib

import hypothesis
import numpy as np
import pytest
from hypothesis import strategies as st

from tidewave.llm import periodic_runs as pr
from tidewave.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least=6, exponent=4):
    found = {}
    n = len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def runs(x, **how):
    return [tuple(r[1:]) for r in pr.find_runs(np.array(x, np.int64), np.array([0, len(x)]), **how).tolist()]


def test_small_cases():
    assert runs([1] * 5) == [] and runs([1] * 6) == [(0, 6, 1)] and runs([1, 2] * 4) == [(0, 8, 2)]
    assert runs([1, 2] * 3 + [1]) == []
    assert runs([]) == [] and runs([1]) == []
    # a period's multiple is no period of its own; runs may overlap and one may lie in another
    assert runs(([1] * 6 + [2]) * 4) == plain_runs(([1] * 6 + [2]) * 4) != []
    with pytest.raises(ValueError):
        runs([1] * 9, exponent=3)


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=4), st.sampled_from([(6, 4), (1, 4), (9, 5), (20, 4)]))
def test_equals_the_plain_search_on_few_letters(texts, how):
    x = np.array([v for t in texts for v in t], np.int64)
    got = pr.find_runs(x, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), *how).tolist()
    assert [tuple(r) for r in got] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, *how)]


@pytest.mark.parametrize("seed", range(40))
def test_equals_the_plain_search_on_repeats_of_repeats(seed):
    r = random.Random(seed)
    x = [0]
    for _ in range(6):
        a = r.randrange(len(x))
        x = x + x[a:] * r.randint(1, 5) + [r.randrange(3) for _ in range(r.randint(0, 2))]
        x = x[:400]
    assert runs(x) == plain_runs(x)


def test_long_texts_take_no_quadratic_time():
    fib = [0], [0, 1]
    while len(fib[1]) < 200_000:
        fib = fib[1], fib[1] + fib[0]
    began = time.time()
    assert runs([7] * 1_000_000) == [(0, 1_000_000, 1)]
    assert runs([1, 2, 3] * 300_000)[0] == (0, 900_000, 3)
    assert runs(([1] * 500 + [2]) * 400)[-1][2] in (1, 501)
    assert runs(fib[1]) == []
    assert time.time() - began < 60


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_its_contract(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("a b c d e".split()) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "x " * 3000), (1004, "x y " * 9 + "é z " * 6), (-7, "a a a a a a"), (1003, "x " * 3000)]
    rows += [(k, "one two three four five six seven eight nine ten eleven twelve " * 3) for k in range(2000, 2100)]
    spark.createDataFrame([(*x, 7, "r") for x in rows], "doc_id long, text string, words int, Runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*x) for x in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_operator_on_odd_tables(spark, documents):
    got = pr.periodic_runs(documents(["a a a a a a a b", None, ""]), ["doc_id"]).orderBy("doc_id").collect()
    assert [(x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in got] == [(8, [(0, 7, 1)], "a b"), (0, [], ""), (0, [], "")]
    assert pr.periodic_runs(documents([]), ["doc_id"]).count() == 0
    d = spark.createDataFrame([(None, "a " * 6, 1, 2)] * 2, "doc_id long, text string, runs int, Words int")
    assert [(x.doc_id, x.Words, x.collapsed) for x in pr.periodic_runs(d, d.columns).collect()] == [(None, 2, "a")] * 2
