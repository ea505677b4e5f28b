"""Near words against all pairs, variants against a plain reading of the contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewave.llm import queries, spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=5):
    words = sorted(counts)
    of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(of[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(of[w]), form[w] and counts[form[w]]))
    return out


def variants(spark, counts):
    return {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}


def some_words(seed, letters, sizes, n):
    r = random.Random(seed)
    out = {"".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(n)}
    return {w: r.choice([1, 1, 2, 5, 6, 25, 30, 150, 900, 4500]) for w in sorted(out)}


@pytest.mark.parametrize(("letters", "sizes", "n"), [("ab", range(1, 9), 300), ("abcé", (6, 7), 400), ("abcdefgÿ", (3, 4), 500), ("ab", (30, 31, 60), 60)])
def test_equals_all_pairs(spark, letters, sizes, n, monkeypatch):
    counts = some_words(n, letters, sizes, n)
    w = next(iter(counts))
    counts |= {w * 3 + "x" * 5000: 7, w * 3 + "x" * 5001: 70, "": 4}
    assert variants(spark, counts) == plain(counts)
    # blocks divided down to a single place give the same
    monkeypatch.setattr(spelling, "LARGEST", 3)
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 50)
    assert variants(spark, counts) == plain(counts)


def test_chains_ties_and_empty(spark):
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 624, "aaaaac": 5}
    got = {r[0]: r for r in variants(spark, counts)}
    assert got["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and got["aaabbb"][1:] == (None, "aaabbb", 125, 2, None)
    assert variants(spark, {"x": 1}) == {("x", None, "x", 1, 0, None)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            total[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_query_equals_its_contract(spark, tmp_path):
    r = random.Random(3)
    base = ["maison", "maisons", "Straße", "ÉLÈVES", "élèves", "x×y÷zzz", "common", "comnon", "shorter", "short"]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", "", "-", "1", "’s", "Ā"]) for _ in range(60))) for i in range(900)]
    rows += [(-3, None), (9000, ""), (9001, "abcdefgh " * 3000 + "é" * 40_000), (9001, "abcdefgh " * 3000)]
    spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n int, Word string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    want = plain(counted(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == want and len(want) > 10 and any(x[1] for x in want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_spelling_variants(spark, f"{tmp_path}/none").count() == 0
