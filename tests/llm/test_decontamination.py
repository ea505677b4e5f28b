"""Containment search against brute force."""

import random

from tidewave.llm import decontamination


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_equals_brute_force(spark, documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 30, 80, 400)] + ["two words", "", None]
    docs = []
    for k in range(80):
        body = [word() for _ in range(rng.choice([3, 50, 3000]))]
        piece = (rng.choice(items) or "").upper().split()
        for _ in range(rng.randint(0, 3)):
            if piece:
                piece[rng.randrange(len(piece))] = word() if rng.random() < 0.5 else piece[0]
        at = rng.randrange(len(body))
        docs.append("\n".join([" ".join(body[:at]), " ".join(piece), " ".join(body[at:])]))
    docs += ["", None, "Two  WORDS", "x two words y"]
    want = set()
    for i, item in enumerate(items):
        k = min(5, len((item or "").split()))
        s = grams(item, k) if k else set()
        want |= {(d, i) for d, t in enumerate(docs) if s and 100 * len(s & grams(t, k)) >= 80 * len(s)}
    b = spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(docs), b).collect()}
    assert got == want and len(want) > 20
    clean = decontamination.clean(documents(docs), b)
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_blocks_give_the_same(spark, documents, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(10)]
    docs = documents([f"head {items[3][1]} tail", items[7][1], "nothing"])
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, b).collect()))
    monkeypatch.setattr(decontamination, "MAX_BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontamination.contaminated(docs, b).collect())) == want == [(0, 3, 16, 16), (1, 7, 16, 16)]


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(documents(["a b c d e f"]), none).count() == 0
    assert decontamination.contaminated(documents([]), none).count() == 0


def test_long_texts_repeats_and_clashing_names(spark):
    item = " ".join(f"i{j}" for j in range(30))
    long = " ".join(f"w{j}" for j in range(200_000))
    rows = [(1, f"{long} {item} {long}"), (1, "other"), (2, long), (2, long), (3, item), (3, item), (None, item)]
    d = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], "doc_id long, text string, _found string, item_id string, n_item int")
    b = spark.createDataFrame([(7, item, "z"), (7, item, "z"), (8, f"{item} tail", "z")], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, decontamination.contaminated(d, b).collect()))
    assert got == [(1, 7, 26, 26), (1, 8, 26, 27), (3, 7, 26, 26), (3, 8, 26, 27)]
    left = decontamination.clean(d, b)
    assert left.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 2), (False, 2), (True, 0)]
