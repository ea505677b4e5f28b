"""Bit-sliced search, URL filters and WARC against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tidewave.llm import bit_sliced, url_filters, warc


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 8)).round(2)
    x[7] = x[3]
    x[10:20] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(50, rows[50][1]), (400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [(i, np.floor(256 * np.asarray(np.float32(v), np.float64)).astype(np.int64)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, u in dict(q).items():
        if i % 50 == 0:
            best = sorted((-int(u @ v), j) for j, v in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bit_sliced.top_k(d).collect())
    assert got == sorted(want)


def test_blocks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "ROWS", 64)
    monkeypatch.setattr(bit_sliced, "QUERIES", 1)
    d = spark.createDataFrame([(i, [float(i % 7), -0.5]) for i in range(500)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bit_sliced.top_k(d).collect()}
    for q in range(0, 500, 50):
        u = np.array([256 * (q % 7), -128])
        best = sorted((-(int(u @ np.array([256 * (j % 7), -128]))), j) for j in range(500) if j != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert bit_sliced.top_k(d.limit(0)).count() == 0
    assert bit_sliced.top_k(d.where("vec_id in (0, 3)")).count() == 1


def test_large_components_and_empty_vectors(spark):
    rows = [(0, [2e9, -3.0]), (1, [2e3, 1.0]), (2, [-2e9, 5e9]), (3, [0.5, 0.25]), (50, []), (51, []), (52, [])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, block int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bit_sliced.top_k(d.where("vec_id <> 2")).collect())
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    dot = lambda i, j: sum(a * b for a, b in zip(x[i], x[j], strict=True))
    assert got == [(0, 1, 1, dot(0, 1)), (0, 2, 3, dot(0, 3)), (50, 1, 51, 0), (50, 2, 52, 0)]
    for bad in ([(0, [2e12, 1.0]), (1, [2e12, 1.0])], [(0, [3e30]), (1, [1.0])]):
        with pytest.raises(Exception, match="is no long|too large"):
            bit_sliced.top_k(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).collect()


def test_urls(spark):
    rows = ["http://A.Example.COM/en/7x?q", "https://example.com/en/9#t", "ftp://x.example.net/de/81", "http://net/de/1", "http://a.org/es/", "http://a.org/es", None, "no scheme", "http://h", "x://é.COM/EN/7", "http://example.com/en/7\n", "a://b://c/d", "http://notexample.net/de/8"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filters.judge(d).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7")
    assert got[1] == ("example.com", "/en/9", "com/en/") and got[2] == ("x.example.net", "/de/81", "example.net/de/8")
    assert got[3] == ("net", "/de/1", "net/de/") and got[4][2] == "org/es/" and got[5] == ("a.org", "/es", None)
    assert got[6] == ("", "", None) == got[7] and got[8] == ("h", "", None) and got[9] == ("é.com", "/EN/7", None)
    assert got[11] == ("b:", "//c/d", None) and got[12][2] == "net/de/"
    assert url_filters.judge(d.limit(0)).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rows = [f"http://bad.com/shop/item{k}" for k in range(30)] + ["http://bad.com/news/a", "http://good.com/shop/item1"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [("block", f"bad.com/shop/item{k}") for k in range(3, 10)]
    got = {r.page_id: (r.verdict, r.template) for r in url_filters.judge(d, rules).collect()}
    assert got[20] == ("block", "/shop/*") and got[30][0] == "allow" and got[31][0] == "allow"


def test_branches_are_merged_up_to_the_host(spark):
    rows = [f"http://bad.com/{a}/item{k}" for a in ("shop", "sale") for k in range(10)] + ["http://bad.com/news/a", "http://bad.com/", "http://bad.com/x/y/z/w", "http://good.com/shop/item1"]
    rows += [f"http://mix.com/a/{b}/p{k}" for b in ("spam", "spam/r", "ham", "ham/r") for k in range(20)] + ["http://mix.com/a/spam/q/r", "http://mix.com/a/new", "http://mix.com/b"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [("block", "bad.com/shop/item"), ("block", "bad.com/sale/item"), ("block", "mix.com/a/spam/p"), ("block", "mix.com/a/spam/r/p"), ("allow", "mix.com/a/ham/")]
    got = {rows[r.page_id]: r for r in url_filters.judge(d, rules).collect()}
    assert len(got) == len(rows)
    for u in ("http://bad.com/news/a", "http://bad.com/", "http://bad.com/x/y/z/w"):
        assert (got[u].rule, got[u].verdict, got[u].purity) == (None, "block", round(20.8 / 24, 9))
    assert got["http://mix.com/a/spam/q/r"].verdict == "block" and got["http://mix.com/a/spam/q/r"].purity == round(40.8 / 44, 9)
    assert got["http://mix.com/a/new"].purity == 0.2 == got["http://mix.com/b"].purity and got["http://good.com/shop/item1"].verdict == "allow"
    only = {rows[r.page_id]: r for r in url_filters.judge(d, rules[:1]).collect()}
    assert only["http://bad.com/news/a"].verdict == "allow" and only["http://bad.com/shop/item3"].purity == round(10.8 / 14, 9)


def test_deep_and_wide_paths_keep_their_verdicts(spark):
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(40)]
    deep = [f"http://d.com/a/b/c/{x}/{y}/p{k}" for x in ("spam", "news") for y in ("u", "v") for k in range(10)] + [f"http://d.com/a/b/c/{x}/w" for x in ("spam", "news")]
    wide = [f"http://w.com/{x}/{y}/p{k}" for x in names for y in ("u", "v") for k in range(5)] + ["http://w.com/ab/w", "http://w.com/ac/w"] + [f"http://w.com/{x}z" for x in names]
    rows = deep + wide
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [(v, f"d.com/a/b/c/{x}/{y}/") for v, x in (("block", "spam"), ("allow", "news")) for y in ("u", "v")]
    rules += [("block" if x == "ab" else "allow", f"w.com/{x}/{y}/") for x in names for y in ("u", "v")]
    got = {rows[r.page_id]: r for r in url_filters.judge(d, rules).collect()}
    assert len(got) == len(rows)
    assert got["http://d.com/a/b/c/spam/w"].verdict == "block" and got["http://d.com/a/b/c/news/w"].verdict == "allow"
    assert got["http://w.com/ab/w"].verdict == "block" and got["http://w.com/ac/w"].verdict == "allow"
    assert got["http://w.com/ab/u/p1"].template == "/ab/u/*" and got["http://w.com/abz"].template == "/*"


def test_alike_branches_are_merged_with_each_other(spark):
    rows = [f"http://h.com/{a}/p/u{k}" for a in ("ham", "eggs", "tea") for k in range(40)] + [f"http://h.com/{a}/{b}/u{k}" for a in ("spam", "junk") for b in "pq" for k in range(5)] + ["http://h.com/spam/x", "http://h.com/junk/x", "http://h.com/tea/x"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [("allow", f"h.com/{a}/p/") for a in ("ham", "eggs", "tea")] + [("block", f"h.com/{a}/{b}/") for a in ("spam", "junk") for b in "pq"]
    got = {rows[r.page_id]: r for r in url_filters.judge(d, rules).collect()}
    assert {(got[f"http://h.com/{a}/x"].verdict, got[f"http://h.com/{a}/x"].purity) for a in ("spam", "junk")} == {("block", round(20.8 / 24, 9))}
    assert got["http://h.com/tea/x"].verdict == "allow"


def test_tree_equals_sql_and_repeats_and_names_clash(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "c", "dd", "e7", "f" * 30, "", "é"])
    urls = [f"http://{rng.choice(['x.com', 'y.com', 'sub.x.com'])}/{'/'.join(part() for _ in range(rng.randint(0, 7)))}" for _ in range(1500)] + [None, "none", "http://z"]
    urls += urls[:50]
    rules = [("block", "x.com/a/"), ("allow", "x.com/b"), ("block", "y.com/c/a"), ("allow", "y.com/dd/"), ("block", "sub.x.com/b/b"), ("allow", "x.com/a/c/")]
    rows = [(k, u, "clash", "clash", "clash", 1) for k, u in enumerate(urls)] + [(3, urls[3], "clash", "clash", "clash", 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string, key string, _salt string, n int")
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    got = sorted(map(str, (tuple(r) for r in url_filters.judge(d, rules).select(*columns).collect())))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows]}))
    want = sorted(str(tuple(r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({url_filters.sql(rules)})").fetchall())
    assert got == want and len({r.split(", ")[4] for r in got}) > 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows_of(n=60):
    rng = random.Random(1)
    body = ["é" * 700, "x" * 1000, "y" * 999, "z" * 5000]
    return [(k * 37, f"http://h/{k}\n evil", rng.choice([*body, None, "", f"own {k}" * 300])) for k in range(n)]


def test_warc_round_trip(spark, scratch):
    rows = rows_of() + [(None, "u", "x")]
    folder = f"{scratch.root}/a"
    manifest = warc.write(pages(spark, rows), folder, scratch, roll=2000).collect()
    assert len(manifest) > 3 and [m.name for m in manifest] == sorted(m.name for m in manifest)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    last = {}
    for i, _, h in rows[:-1]:
        last[h or ""] = max(i, last.get(h or "", -1))
    for i, _, h in rows[:-1]:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and last[h or ""] > i
        assert got[i].payload_digest == hashlib.sha1(b).hexdigest() and got[i].record_type == ("revisit" if revisit else "response")
        assert got[i].refers_to == (last[h or ""] if revisit else None) and got[i].payload == (None if revisit else b)
    full = {r.page_id: r.payload_bytes for r in warc.round_trip(pages(spark, rows)).collect()}
    assert full == {i: len((h or "").encode()) for i, _, h in rows[:-1]}


def test_warc_bytes_do_not_hang_on_partitions(spark, scratch):
    files = []
    for k, n in enumerate((1, 7)):
        folder = f"{scratch.root}/d{k}"
        warc.write(pages(spark, rows_of()).repartition(n), folder, scratch, roll=3000)
        files.append(sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect()))
    assert files[0] == files[1]


def test_members_end_with_zero_and_damage_is_seen():
    gz = warc.member(b"WARC/1.1\r\n")
    assert gz[-1] == 0
    good = warc.member(warc.record_bytes(1, "u", b"p", hashlib.sha1(b"p").digest(), 1))
    assert [f["X-Page-Id"] for f, _ in warc.records(good + good)] == ["1", "1"]
    with pytest.raises(ValueError):
        list(warc.records(good[:-9]))


def test_warc_of_nothing(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_of_repeated_ids_large_payloads_and_clashing_names(spark, scratch):
    rng = random.Random(3)
    large = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(5, "u", f"body {k % 3} " * 200) for k in range(90)] + [(5, "u", "same " * 300)] * 40 + [(7, "u", "same " * 300), (9, None, large), (2, "u", large), (-3, "v", "")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, k int, digest string")
    warc.write(d, f"{scratch.root}/r", scratch, roll=3000)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read(spark, f"{scratch.root}/r").collect())
    sha = lambda h: hashlib.sha1(h.encode()).hexdigest()
    last = {h: max(i for i, _, g in rows if g == h) for _, _, h in rows}
    want = sorted((i, sha(h), "revisit" if len(h) >= 1000 and last[h] > i else "response", last[h] if len(h) >= 1000 and last[h] > i else 0) for i, _, h in rows)
    assert got == want
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(d).collect()) == sorted((i, len(h)) for i, _, h in rows)


def test_files_begin_where_their_bounds_say():
    bounds = [(1, 0, 0), (4, 5, 1), (4, 5, 7), (4, 9, 2), (8, 1, 1)]
    rows = sorted((p, t, k) for p in (1, 2, 4, 5, 8, 9) for t in (0, 1, 5, 9) for k in (0, 1, 3, 7, 8))
    got = warc.file_of(bounds, *(np.array(x) for x in zip(*rows, strict=True))).tolist()
    assert got == [max([i for i, b in enumerate(bounds) if b <= r], default=-1) for r in rows]
