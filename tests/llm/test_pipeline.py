"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
from test_decontamination import grams
from test_near_dedup import brute as near_brute
from test_substring_dedup import brute as repeats_brute

import sentencepiece

from tidewave.llm.vocabulary import PIECES


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    first = corpus_pipeline.language(spark, docs, data)
    assert first.columns == docs.columns and first.count() == docs.count()
    rows = sorted(first.select("doc_id", "text").collect())
    roots, _ = near_brute([r.text for r in rows], 80)
    kept = [r for i, r in enumerate(rows) if roots[i] == i]
    _, words = repeats_brute([r.text for r in kept])
    left = [(r.doc_id, r.text if len(w) == len(r.text.split()) else " ".join(w)) for r, w in zip(kept, words, strict=True) if w or not r.text.split()]
    items = [s for s in map(grams, bench) if s]
    left = [(d, t) for d, t in left if not any(100 * len(s & grams(t)) >= 80 * len(s) for s in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert sorted(got) == [d for d, _ in left]
    for d, t in left:
        assert got[d].tokens == sp.encode(t) and got[d].round_trip


def test_nulls_empties_and_repeats(spark, data):
    rows = [(1, "the cat sat on the mat and ran off", "en", "s", 3), (1, "the cat sat on the mat and ran off", "en", "s", 3), (2, None, None, None, None), (None, "der hund ist hier und da", "de", None, 1), (3, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, data)
        assert out.columns == d.columns
        d = spark.createDataFrame(out.collect(), d.schema)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect()) == [(False, 1), (True, 0)]
    assert corpus_pipeline.tokens(spark, d.limit(0), data).count() == 0


def test_clashing_names_and_very_long_texts(spark, data):
    names = ["_gone", "_twice", "_found", "lang_pred", "lang_score", "_place", "Spans", "_salt", "h", "n", "tokens", "round_trip", "kept", "component_id"]
    long = " ".join(f"the cat {k} sat on the mat" for k in range(20_000))
    texts = ["the cat sat on the mat and ran off", long, long + " again", "der hund ist hier und da im haus", "the cat sat on the mat and ran off"]
    rows = [(k, t, "de" if "hund" in t else "en", "s", 1, *(f"{c}{k}" for c in names)) for k, t in enumerate(texts)]
    rows.append((0, "zz " + rows[0][1], *rows[0][2:]))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, data)
        assert out.columns == d.columns
        d = spark.createDataFrame(out.collect(), d.schema)
        assert all(r[c] == f"{c}{r.doc_id}" for r in d.collect() for c in names), name
    assert sorted(r.doc_id for r in d.collect()) == [0, 1, 3]
    assert {r.text for r in d.where("doc_id = 0").collect()} == {texts[0]}
    assert corpus_pipeline.tokens(spark, d, data).columns == ["doc_id", "n_tokens", "tokens", "round_trip"]
