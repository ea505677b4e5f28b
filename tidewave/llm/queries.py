"""The queries op1 to op13 and pipeline: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewave.llm import bit_sliced, bpe_lexicon, decontamination, language_id, near_dedup, periodic_runs, quality, sentencepieces, spelling, substring_dedup, token_counts, url_filters, warc
from tidewave.llm._shared import small_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    found = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = lambda c: language_id.held_out(F.col(c), 5, 0)
    model = quality.train(docs.where(~out("doc_id")), labels.where(~out("doc_id")))
    return quality.scored(docs.select("doc_id", "text"), model, keep=["doc_id"], cut=0.3).select("doc_id", out("doc_id").alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(_table(spark, sf_dir, "documents")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=80)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def _with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; where 10 divides the checksum of doc_id, the words from some place on repeat. Null ids have none."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                g, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
                words = (texts[i] or "").encode().split() if doc_id is not None and h == 0 else []
                if words:
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    texts[i] = b" ".join(words[:a] + (tail * (len(words) // p + 1))[: len(words) - a]).decode()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = periodic_runs.periodic_runs(_with_tails(_table(spark, sf_dir, "documents")), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    longest = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")]
    return out.select("doc_id", "n_runs", *longest, F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), lost_every=199))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe_lexicon.encoded(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = bpe_lexicon.decoded(tokens, keep=["doc_id", "tokens"])
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def near_sql(source: str, percent: int) -> str:
    """CTEs that end in near_found(doc_id, n_shingles, component_id), over a relation of doc_id and text."""
    return f"""
near_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM {source}),
near_shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM near_words)),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_shingles GROUP BY doc_id),
near_pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM near_shingles a JOIN near_shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near_links AS (SELECT a, b FROM near_pairs JOIN near_sizes x ON x.doc_id = a JOIN near_sizes y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
near_edges AS (SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links),
near_reach(node, root) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT b, root FROM near_reach JOIN near_edges ON a = node AND root <= b),
near_found AS (SELECT node AS doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id FROM near_reach LEFT JOIN near_sizes s ON s.doc_id = node GROUP BY node)"""


def contained_sql(source: str, items: str, percent: int) -> str:
    """CTEs that end in leaks(doc_id, item_id, n_shared, n_item); items of fewer than 5 words are looked for as runs."""
    grams = "list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))"
    lower = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_WORD})"
    return f"""
leak_docs AS (SELECT doc_id, {lower} AS ws FROM {source} WHERE text IS NOT NULL),
leak_items AS (SELECT item_id, {lower} AS ws FROM {items} WHERE text IS NOT NULL),
leak_doc_grams AS (SELECT DISTINCT doc_id, unnest({grams}) AS s FROM leak_docs WHERE len(ws) >= 5),
leak_item_grams AS (SELECT DISTINCT item_id, unnest({grams}) AS s FROM leak_items WHERE len(ws) >= 5),
leak_sizes AS (SELECT item_id, count(*) AS n FROM leak_item_grams GROUP BY item_id),
leak_shared AS (SELECT doc_id, item_id, count(*) AS k FROM leak_doc_grams JOIN leak_item_grams USING (s) GROUP BY 1, 2),
leaks AS (SELECT doc_id, item_id, k AS n_shared, n AS n_item FROM leak_shared JOIN leak_sizes USING (item_id) WHERE 100 * k >= {percent} * n
    UNION SELECT doc_id, item_id, 1, 1 FROM leak_docs d JOIN leak_items i ON len(i.ws) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(i.ws, ' ') || ' '))"""


def repeats_sql(source: str) -> str:
    """CTEs that end in rep_kept(doc_id, n_words, n_removed, kept, ws), over a relation of doc_id and text."""
    return f"""
rep_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM {source}),
rep_windows AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, ws FROM rep_words WHERE len(ws) >= 13),
rep_hashed AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS w FROM rep_windows),
rep_first AS (SELECT w, min(doc_id) AS low FROM rep_hashed GROUP BY w HAVING count(DISTINCT doc_id) > 1),
rep_covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM rep_hashed JOIN rep_first USING (w) WHERE doc_id > low),
rep_each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM rep_words),
rep_some AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM rep_each ANTI JOIN rep_covered USING (doc_id, pos) GROUP BY doc_id),
rep_kept AS (SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, coalesce(kept, '') AS kept FROM rep_words LEFT JOIN rep_some USING (doc_id))"""


#: A CTE with the table of the checksum's 256 values, by its rule.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i,
    list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i)))"""


def _crc32(octets: str) -> str:
    """The checksum of a list of octets, beside crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::BIGINT + 1])), 4294967295)"


def _digits(number: str) -> str:
    return f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)"


_RUNS_SQL = f"""
WITH {_CRC_TABLE},
base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws, {_crc32(_digits("doc_id"))} AS h FROM documents, crc_table),
sized AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h % 10 = 0 AND len(ws) > 0 AS odd, (h // 10)::BIGINT AS g FROM base),
tail AS (SELECT *, CASE WHEN odd THEN g % n END AS a, CASE WHEN odd THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
texts AS (SELECT doc_id, n, CASE WHEN odd THEN list_transform(range(n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE ws END AS ws FROM tail),
each AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM texts),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM each x JOIN each y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM isles WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, s, length),
sums AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': s, 'l': length, 'q': q}}, (length, -s, -q)) AS best,
    sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
    coalesce(sha, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM texts LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
said AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
said_in AS (SELECT doc_id, w, count(*) AS k FROM said WHERE length(w) >= 6 GROUP BY doc_id, w),
octets AS (SELECT *, {_digits("doc_id")} || [58::UBIGINT] || flatten(list_transform(string_split(w, ''), lambda d: CASE WHEN unicode(d) < 128 THEN [unicode(d)::UBIGINT] ELSE [195::UBIGINT, (unicode(d) - 64)::UBIGINT] END)) AS o FROM said_in),
hashed AS (SELECT w, k, {_crc32("o")} AS h FROM octets, crc_table),
lost AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
    UNION SELECT d, cut.word FROM cut JOIN words ON words.word = d UNION SELECT cut.word, d FROM cut JOIN words ON words.word = d),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, encode(b))) AS form, max(n) AS form_n FROM pairs JOIN words ON word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, here, hop) AS (SELECT word, word, 0 FROM words UNION ALL SELECT chain.word, form, hop + 1 FROM chain JOIN forms ON forms.word = here WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(here, hop) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS sha FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM d)
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN n >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND last > page_id THEN last END AS refers_to FROM m"""

_TOP_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0)::BIGINT AS score
    FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bit_sliced_top_k": op2_bit_sliced_top_k,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_url_filters": op5_url_filters,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe": op13_bpe,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_bit_sliced_top_k": _TOP_SQL,
    "op5_url_filters": url_filters.sql(),
    "op6_minhash_near_dedup": f"WITH RECURSIVE {near_sql('documents', 85)}\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near_found",
    "op7_warc": _WARC_SQL,
    "op8_benchmark_decontamination": f"WITH {contained_sql('documents', 'benchmark', 80)}\nSELECT doc_id, item_id, n_shared, n_item FROM leaks",
    "op10_substring_dedup": f"WITH {repeats_sql('documents')}\nSELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM rep_kept",
    "op11_periodic_runs": _RUNS_SQL,
    "op12_spelling_variants": _SPELLING_SQL,
}
