"""Encoding and decoding against the tokenizers library, the automaton against a dictionary."""

import hashlib
import random

import hypothesis
import numpy as np
import pytest
import tokenizers
from hypothesis import strategies as st
from tokenizers import pre_tokenizers

from tidewave.llm import bpe_lexicon as bl
from tidewave.llm import queries

END = "<|endoftext|>"
ODD = ["", " ", "  a b  ", "Hello  world\n x\t", "ﬁ é é 　x 漢字 🙂", "a" * 2000, "!!!====----" * 9, "a\x00b", "   " * 9 + "x", "I'm he's we'll they've you're I'd can't 'twas ''s 'S 'sx x'rest '", f"a{END}b  {END} {END}{END}", "\x1c\x1d x\x85y  z", "12 3４५½ x1y2", "\n's \n 't  'll", " 're", "'", "'l", "'vé", "\n", "a \n", "a\n b c  d", "<|endoftext|", "ǅ'ſ'ś"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bl.FILE)


@pytest.fixture(scope="module")
def words():
    return [w.encode() for w in ["the", " the", " there", "then", " thens", "hend", "hends", "s", "'s", " é", "aaaa"]]


@pytest.fixture(scope="module")
def lexicon(words):
    m = bl.model()
    size = np.array([len(w) for w in words])
    ids, n = bl.merge(m, np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    return bl.Lexicon(bl.Lexicon.compiled(dict(zip(words, [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])], strict=True))))


def check(library, lexicon, texts):
    m = bl.model()
    ids, b = bl.encode(m, lexicon, texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[b[i] : b[i + 1]].tolist() for i in range(len(texts))] == want
    assert bl.decode(m, ids, b) == [library.decode(w, skip_special_tokens=False) for w in want] == texts


def test_equals_the_library(library, lexicon, data, spark):
    check(library, lexicon, ODD)
    check(library, lexicon, [])
    check(library, lexicon, [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    check(library, bl.Lexicon(bl.Lexicon.compiled({})), ODD)


@hypothesis.settings(max_examples=200, deadline=None)
@hypothesis.given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["a", "b", " ", "  ", "'", "s", "ll", "re", "thens", " the", "1", "\n", "é", "🙂", ".", "\u3000", END]), max_size=20).map("".join)), max_size=6))
def test_equals_the_library_on_any_text(library, lexicon, texts):
    check(library, lexicon, texts)


def test_every_character_is_of_the_librarys_class(library):
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    got = bl.pieces([f"A{c}1{c}!{c}A" for c in chars], {})
    want = [len(split.pre_tokenize_str(f"A{c}1{c}!{c}A")) for c in chars]
    assert np.diff(got.first).tolist() == want


def test_automaton_is_minimal_and_numbers_words(words, lexicon):
    flat = np.frombuffer(b"".join([*words, b"thes", b"", b"hen"]), np.uint8)
    size = np.array([len(w) for w in [*words, b"thes", b"", b"hen"]])
    assert lexicon.numbers(flat, np.cumsum(size) - size, size).tolist() == [sorted(words).index(w) for w in words] + [-1] * 3
    # states are as many as there are different sets of what may follow a prefix
    follow = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(lexicon.final) == len(follow)


def test_long_pieces_and_random_ones(library, lexicon):
    r = random.Random(1)
    check(library, lexicon, ["".join(r.choice("abcdeth") for _ in range(n)) for n in (47, 48, 49, 50, 3000)] * 3 + ["=" * 100_000, "ab" * 30_000])


def test_same_hash_is_told_apart(monkeypatch):
    p = bl.pieces(["a b a c bb"], {})
    monkeypatch.setattr(bl, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    some, kind = p.distinct()
    assert kind.tolist() == [0, 1, 2, 3, 4] and some.tolist() == [0, 1, 2, 3, 4]
    assert bl.pieces(["a a a"], {}).distinct()[1].tolist() == [0, 1, 1]


def test_query_equals_the_library(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 100_000), (101, "again")] + [(200 + i, "the same text again, the same text") for i in range(60)]
    spark.createDataFrame([(*x, 3, "t") for x in rows], "doc_id long, text string, tokens int, N_tokens string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_bpe(spark, str(tmp_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, t in rows]
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_operators_on_odd_tables(spark, documents):
    assert bl.encoded(documents([]), ["doc_id"]).count() == 0
    d = spark.createDataFrame([(1, "a b", 7, None)] * 2, "doc_id long, text string, tokens int, Ids string")
    e = bl.encoded(d, d.columns)
    assert [(r.doc_id, r.text, len(r.tokens)) for r in e.collect()] == [(1, "a b", 2)] * 2
    ids = spark.createDataFrame([(1, [64, None, -1, 10**6, 50256]), (2, None), (3, []), (4, [140, 64])], "k long, tokens array<int>")
    assert [tuple(r) for r in bl.decoded(ids, ["k"]).orderBy("k").collect()] == [(1, "a<|endoftext|>"), (2, None), (3, ""), (4, "�a")]


def test_most_frequent_pieces(documents):
    texts = [f" w{k % 40}x" * (k % 7 + 1) + " the" * (k % 5) for k in range(200)] + [None, "", "<|endoftext|>" * 9]
    got = [(bytes(r.piece), r.n) for r in bl.frequent_pieces(documents(texts), most=12).collect()]
    p = bl.pieces([t or "" for t in texts], bl.model().special)
    n = {}
    for a, size, s in zip(p.start.tolist(), p.size.tolist(), p.special.tolist(), strict=True):
        if s < 0:
            w = p.data[a : a + size].tobytes()
            n[w] = n.get(w, 0) + 1
    assert got == sorted(n.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert bl.frequent_pieces(documents([])).count() == 0
    assert bl.frequent_pieces(documents(["a b"]), most=99).count() == 2
