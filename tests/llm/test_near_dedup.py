"""SetSketch near-dedup against all pairs by brute force."""

import math
import random

import numpy as np
import pytest

from tidewave.llm import near_dedup
from tidewave.llm.components import connected_components


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, percent):
    s, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(s))], [len(x) for x in s]


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(rng.randint(20, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + ["", None, "one two", "One  TWO", "a b c d e", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_equals_all_pairs(documents, percent, seed):
    texts = corpus(seed)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(texts), percent).collect()}
    roots, sizes = brute(texts, percent)
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (roots[i] == i) for i in range(len(texts)))


def test_degenerate(spark, documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    d = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, component_id string, n long")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()) == [(1, 1, True), (2, 1, False)]
    long = documents([" ".join(f"w{i}" for i in range(60_000)), "x", " ".join(f"w{i}" for i in range(59_999))])
    assert [r.component_id for r in near_dedup.near_duplicates(long).orderBy("doc_id").collect()] == [0, 1, 0]


def several_rows(rows, percent):
    """Components of ids whose rows may differ, by brute force over rows."""
    roots, sizes = brute([t for _, t in rows], percent)
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(rows):
        a, b = sorted((find(i), find(rows[roots[k]][0])))
        root[b] = a
    out = {}
    for k, (i, _) in enumerate(rows):
        out[i] = (max(out.get(i, (0,))[0], sizes[k]), find(i))
    return out


@pytest.mark.parametrize("seed", [1])
def test_rows_of_one_id_may_differ_and_come_in_any_order(spark, seed):
    a, c = " ".join(f"a{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    rows = [(1, a), (5, a + " x"), (5, c), (9, c + " y"), (7, ""), (7, None), (7, "one"), (3, c), (3, "one")]
    rng = random.Random(seed)
    texts = corpus(seed)
    rows += [(rng.randrange(100, 160), t) for t in texts] + [(200, f"u{k} v w x y z") for k in range(30)]
    want = several_rows(rows, 85)
    assert {want[i][1] for i in (1, 3, 5, 7, 9)} == {1} and len({x for _, x in want.values()}) > 3
    for _ in range(2):
        rng.shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)


def test_estimate_and_merge():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (700, 150, 150))
    x, y = near_dedup.registers(np.r_[both, a]), near_dedup.registers(np.r_[both, b])
    j = near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([850.0]), np.array([850.0]))[0]
    assert j == pytest.approx(0.7, abs=0.12)
    assert (np.maximum(x, y) == near_dedup.registers(np.r_[both, a, b])).all()


def test_components(spark, scratch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch, "t").collect()}
    assert got == {i: find(i) for i in list(root)}


@pytest.mark.parametrize("percent", [80, 85])
def test_estimating_loses_no_more_pairs_than_banding(percent):
    n, p = near_dedup.REGISTERS, percent / 100
    few = math.ceil(near_dedup._least(percent) * n)
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(few))
    assert lost <= (1 - p**near_dedup.ROWS) ** near_dedup.BANDS
    a = np.full((1, n), 100, np.uint16)
    b = a.copy()
    b[0, : (n - few) // 2 - 1] += 1
    b[0, -((n - few) // 2 - 1) :] -= 1
    sizes = np.array([1000])
    assert near_dedup._near(a, b, sizes, sizes, percent).all()


def test_a_group_of_documents_that_are_alike_but_not_near(documents):
    """Many pairs share bands and stay below the threshold, some reach it; all are told apart by brute force."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 3])):
            w[rng.randrange(80)] = f"own{k}x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(texts), 80).collect()}
    roots, _ = brute(texts, 80)
    assert [got[i] for i in range(len(texts))] == roots and len(set(roots)) > 5
