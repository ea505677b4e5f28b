"""Encoding against the library, token histograms against counting."""

import hypothesis
import pytest
import sentencepiece
from hypothesis import strategies as st

from tidewave.llm import sentencepieces, token_counts
from tidewave.llm.vocabulary import PIECES, pieces


@pytest.fixture(scope="module")
def both():
    return sentencepieces.Vocabulary(pieces()), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def check(both, texts):
    v, sp = both
    ids, b = sentencepieces.encode(v, texts)
    assert [ids[b[i] : b[i + 1]].tolist() for i in range(len(texts))] == [sp.encode(t) for t in texts]
    assert sentencepieces.decode(v, ids, b) == [t.replace("▁", " ").encode() for t in texts]


def test_equals_the_library(both, data, spark):
    check(both, ["", " ", "  a b  ", "Hello  world\n x\t", "ﬁ é é \u3000x 漢字 🙂", "a" * 2000, "▁x", "<s> </s> <0x0A>", "!!!====----" * 9, "a\x00b", "   " * 9 + "x"])
    check(both, [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()])


@hypothesis.settings(max_examples=60, deadline=None)
@hypothesis.given(st.lists(st.text(alphabet=st.sampled_from("abc thein gé漢🙂\n.,%▁0"), max_size=40), max_size=6))
def test_equals_the_library_on_any_text(both, texts):
    check(both, texts)


def test_operator(documents):
    got = sentencepieces.encoded(documents(["a b", None, "", "x" * 20_000]), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_tokens is None, r.round_trip) for r in got] == [(False, True), (True, False), (False, True), (False, True)]
    assert got[1].tokens is None and got[2].tokens == [] and len(got[0].tokens) == got[0].n_tokens == 2
    assert sentencepieces.encoded(documents([]), ["doc_id"]).count() == 0


def test_histogram(documents):
    texts = ["a b c"] * 3 + ["hello there general kenobi " * k for k in range(1, 30)] + [None, ""]
    import base64

    import tiktoken

    with open(token_counts.RANKS, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    h = token_counts.length_histogram(token_counts.token_lengths(documents(texts))).persist()
    for r in h.collect():
        assert r.docs == n.count(r.n_tokens)
        assert r.docs_ge == sum(x >= r.n_tokens for x in n) and r.tokens_ge == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.total_tokens == sum(n) and r.total_docs == len(n)
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    for r in token_counts.at_limits(h, [0, 7, 50, 10**6]).collect():
        assert (r.docs_over, r.tokens_kept) == (sum(x > r.context for x in n), sum(min(x, r.context) for x in n))
    assert {r.share: r.n_tokens for r in token_counts.at_quantiles(h, [0.5, 1.0]).collect()} == {0.5: sorted(n)[(len(n) + 1) // 2 - 1], 1.0: max(n)}
    assert token_counts.length_histogram(token_counts.token_lengths(documents([]))).count() == 0


def test_tables_are_made_once_a_worker(spark):
    v = spark.sparkContext.broadcast(sentencepieces.vocabulary())

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            sentencepieces.encode(v.value, ["some words"] * b.num_rows)
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "made": [sentencepieces.made]})

    def made():
        got = spark.range(40).repartition(20).mapInArrow(run, "pid long, made long").groupBy("pid").agg({"made": "max"}).collect()
        return {r[0]: r[1] for r in got}

    first, then = made(), made()
    assert all(then[pid] == n for pid, n in first.items() if pid in then)


def test_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x")], "doc_id long, text string, n_tokens int, Tokens string")
    got = sentencepieces.encoded(docs, docs.columns).collect()
    assert [(r.doc_id, r.text, r.n_tokens, r.round_trip) for r in got] == [(1, "a b", 2, True)] * 2


def test_lengths_of_long_texts_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "word " * 100_000, 4, "x")] * 2 + [(2, None, 4, "x")], "doc_id long, text string, n_tokens int, docs string")
    got = token_counts.length_histogram(token_counts.token_lengths(d)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs) for r in got] == [(0, 1), (100_001, 2)] and got[1].tokens_ge == 200_002
