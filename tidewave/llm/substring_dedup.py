"""Substring dedup by seed and extend.

A window of LENGTH words holds LENGTH - SEED + 1 seeds of SEED words; the first of those with the least hash is its anchor,
as in winnowing, so equal windows have equal anchors at the same place. Documents are joined on their anchors: each
occurrence meets the first document that has the anchor, and the match is extended both ways, word by word, as far as the
windows of this anchor reach. What the first document doesn't have meets the first of the others, ROUNDS times; windows
that are left then meet, by their words, the first document that has them. Matches of a document that lie on one diagonal
with another one run together to maximal repeats of LENGTH words or more.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch, Words, chunks, record, signed, windows, words
from tidewave.llm.marks import marked, marks
from tidewave.llm.skew import spread_join

LENGTH, SEED = 13, 7
AROUND = LENGTH - SEED
#: Occurrences whose words are laid out at once.
AT_ONCE = 10_000
ROUNDS = 3
EMPTY = hashlib.sha256(b"").hexdigest()

OUTLINE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
#: An anchor at place, and the words of all windows with it, left of them before the anchor. h is a hash of the text.
AROUNDS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("left", pa.int64()), ("ws", pa.string())])
#: A match of n words with source, or, where source is null, an occurrence of which windows are yet to be looked for.
MATCHES = pa.schema([*AROUNDS, ("start", pa.int64()), ("n", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])
WINDOWS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("ws", pa.string())])
STRIPPED = pa.schema([("doc_id", pa.int64()), ("sha_before", pa.string()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _ddl(s: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in s)


def anchored(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, first and last word that a window with it starts at) of every anchor.

    The windows of an anchor start at neighbouring words.
    """
    seeds, where = windows(w, SEED)
    n = len(w.hash) - AROUND
    start = np.flatnonzero(w.doc[: max(n - AROUND, 0)] == w.doc[LENGTH - 1 :])
    if not len(start):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    all_seeds = np.zeros(len(w.hash), np.uint64)
    all_seeds[where] = seeds
    low, at = all_seeds[:n].copy(), np.arange(n)
    for j in range(1, AROUND + 1):
        less = np.flatnonzero(all_seeds[j : n + j] < low)
        low[less], at[less] = all_seeds[less + j], less + j
    low, at = low[start], at[start]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return low[new], at[new], start[new], start[np.r_[new[1:], len(start)] - 1]


def _joined(w: Words) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and where each begins."""
    size = w.end - w.start + 1
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    out = np.full(begin[-1], 32, np.uint8)
    to = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    inner = to < np.repeat(size - 1, size)
    out[inner] = w.data[(to + np.repeat(w.start, size))[inner]]
    return out.tobytes(), begin


def _shas(w: Words) -> list[str]:
    text, begin = _joined(w)
    return [hashlib.sha256(text[begin[a] : max(begin[a], begin[b] - 1)]).hexdigest() for a, b in itertools.pairwise(w.first.tolist())]


def _outline(batches):
    for b in chunks(batches, "text"):
        w = words(b.column("text"))
        yield record(OUTLINE, b.column("doc_id"), w.count(), _shas(w))


def _anchors(batches):
    for b in chunks(batches, "text"):
        w = words(b.column("text"))
        anchor, at, _, _ = anchored(w)
        yield record(ANCHORS, signed(anchor), np.asarray(b.column("doc_id"))[w.doc[at]], at - w.first[w.doc[at]])


def _arounds(batches):
    """The anchors whose places are in `places`, with their words."""
    for b in chunks(batches, "text"):
        w = words(b.column("text"))
        anchor, at, low, high = anchored(w)
        if not len(at):
            continue
        doc = w.doc[at]
        place = at - w.first[doc]
        lists = b.column("places")
        whose = np.repeat(np.arange(b.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
        some = np.flatnonzero(np.isin(doc << 40 | place, whose << 40 | np.asarray(lists.flatten(), np.int64)))
        text, begin = _joined(w)
        text, ids, hs = np.frombuffer(text, np.uint8), np.asarray(b.column("doc_id")), np.asarray(b.column("h"))
        for k in range(0, len(some), AT_ONCE):
            i = some[k : k + AT_ONCE]
            lo, hi = begin[low[i]], begin[high[i] + LENGTH] - 1
            size = hi - lo
            off = np.r_[0, np.cumsum(size)]
            laid = text[np.arange(off[-1]) - np.repeat(off[:-1] - lo, size)]
            ws = pa.LargeStringArray.from_buffers(len(i), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(laid)).cast(pa.string())
            yield record(AROUNDS, signed(anchor[i]), ids[doc[i]], hs[doc[i]], place[i], at[i] - low[i], ws)


def extend(ws: list[str], left: int, other: list[str], other_left: int) -> tuple[int, int] | None:
    """How many words before and after the seed are equal too; None if the seeds' words differ."""
    if ws[left : left + SEED] != other[other_left : other_left + SEED]:
        return None
    a = 0
    while a < min(left, other_left) and ws[left - a - 1] == other[other_left - a - 1]:
        a += 1
    z, i, j = 0, left + SEED, other_left + SEED
    while i + z < len(ws) and j + z < len(other) and ws[i + z] == other[j + z]:
        z += 1
    return a, z


def _alike(b: pa.RecordBatch) -> pa.RecordBatch:
    """The matches of rows whose words are all their source's."""
    place, left, n = b.column("place"), b.column("left"), b.num_rows
    size = pa.compute.add(pa.compute.count_substring(b.column("ws"), " ").cast(pa.int64()), 1)
    ahead = pa.compute.subtract(b.column("source_place"), left)
    none = [pa.nulls(n, f.type) for f in AROUNDS]
    return record(MATCHES, none[0], b.column("doc_id"), b.column("h"), *none[3:], pa.compute.subtract(place, left), size, b.column("source"), ahead)


def _matches(batches):
    """Each occurrence against the first document's: a match, and the windows before and after it that don't match.

    source_ws is null where it says the same as ws, at the same place.
    """
    for b in batches:
        out, rows = [], []
        same = pa.compute.and_(pa.compute.fill_null(pa.compute.equal(b.column("ws"), b.column("source_ws")), True), pa.compute.equal(b.column("left"), b.column("source_left")))
        later = np.flatnonzero(np.asarray(pa.compute.and_(same, pa.compute.greater(b.column("doc_id"), b.column("source")))))
        others = np.flatnonzero(~np.asarray(same))
        columns = ("anchor", "doc_id", "h", "place", "left", "ws", "source", "source_place", "source_left", "source_ws")
        part = b.take(pa.array(others))
        for k, anchor, doc, h, place, left, ws, source, source_place, source_left, source_ws in zip(others.tolist(), *(part.column(c).to_pylist() for c in columns), strict=True):
            match = lambda i, n: out.append((None, doc, h, None, None, None, place - i, n, source, source_place - i))  # noqa: B023, E731
            own = ws.split(" ")
            got = extend(own, left, source_ws.split(" "), source_left)
            # windows are named by how far before the anchor they start
            first, last = left - (len(own) - LENGTH), left
            lo, hi = (max(first, AROUND - got[1]), min(last, got[0])) if got else (0, -1)
            if lo > hi:
                lo, hi = last + 1, last
            elif doc > source:
                match(hi, hi - lo + LENGTH)
            for a, z in ((first, lo - 1), (hi + 1, last)):
                if a <= z:
                    out.append((anchor, doc, h, place, z, " ".join(own[left - z : left - a + LENGTH]), None, None, None, None))
            rows += [k] * (len(out) - len(rows))
        got = record(MATCHES, *(zip(*out, strict=True) if out else [[]] * len(MATCHES)))
        if len(later):
            alike = _alike(b.take(pa.array(later)))
            order = np.argsort(np.r_[later, np.asarray(rows, np.int64)], kind="stable")
            got = pa.Table.from_batches([alike, got]).take(pa.array(order)).combine_chunks().to_batches()[0] if rows else alike
        yield got


def _windows(batches):
    for b in batches:
        out = []
        for doc, h, place, left, ws in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "place", "left", "ws")), strict=True):
            own = ws.split(" ")
            out += [(doc, h, place - left + k, " ".join(own[k : k + LENGTH])) for k in range(len(own) - LENGTH + 1)]
        yield record(WINDOWS, *(zip(*out, strict=True) if out else [[]] * len(WINDOWS)))


def _originals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, sha and original, the smallest doc_id with the same words, of every row."""
    outline = scratch.save(docs.mapInArrow(_outline, _ddl(OUTLINE)), "outline")
    several = outline.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = spread_join(outline, several, ["sha"], F.col("doc_id"), "left").withColumn("original", F.coalesce("first", "doc_id"))
    return scratch.save(out.select("doc_id", "n_words", "sha", "original"), "outlined")


def maximal_repeats(source: DataFrame, scratch: Scratch, bitmap: np.ndarray | None = None) -> DataFrame:
    """source (doc_id, h, text) -> doc_id, h, start, n, source, source_start: what an earlier document has too, in words.

    bitmap: marks of the doc_ids to search, all if there is none; what it lets pass is read in the same worker.

    Every window of LENGTH words that also starts in a document of smaller doc_id lies in one of them. An anchor's group is
    never gathered: it is joined with the row of its first document, and what differs from that with the next one's.
    """
    anchors = source.mapInArrow(_anchors, _ddl(ANCHORS)) if bitmap is None else marked(source, "doc_id", bitmap, then=_anchors, schema=_ddl(ANCHORS))
    shared = scratch.save(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n"), "shared")
    wanted = spread_join(anchors, shared, ["anchor"], F.struct("doc_id", "place")).groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    wanted = scratch.save(wanted, "wanted")
    near = marked(source, "doc_id", marks(wanted.select("doc_id")))
    around = scratch.save(near.join(wanted, "doc_id").select("doc_id", "h", "text", "places").mapInArrow(_arounds, _ddl(AROUNDS)), "around")
    scratch.drop("wanted", "shared")
    columns, found = ["doc_id", "h", "start", "n", "source", "source_start"], []
    for k in range(ROUNDS):
        first = around.groupBy("anchor").agg(F.min(F.struct("doc_id", "place", "left", "ws")).alias("f"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("f.doc_id < high")
        first = scratch.save(first.select("anchor", "n", *[F.col(f"f.{c}").alias(n) for c, n in (("doc_id", "source"), ("place", "source_place"), ("left", "source_left"), ("ws", "source_ws"))]), f"first-{k}")
        met = spread_join(around, first, ["anchor"], F.struct("doc_id", "h", "place", "left"))
        same = (F.col("ws") == F.col("source_ws")) & (F.col("left") == F.col("source_left"))
        met = met.where(~same | (F.col("doc_id") > F.col("source"))).withColumn("source_ws", F.when(~same, F.col("source_ws")))
        matches = scratch.save(met.mapInArrow(_matches, _ddl(MATCHES)), f"matches-{k}")
        scratch.drop("around", f"first-{k}")
        found.append(matches.where("source is not null").select(*columns))
        around = matches.where("source is null").select(*AROUNDS.names)
    rest = scratch.save(around.mapInArrow(_windows, _ddl(WINDOWS)), "rest")
    again = rest.groupBy("ws").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("f.doc_id < high")
    again = scratch.save(again.select("ws", "n", F.col("f.doc_id").alias("source"), F.col("f.start").alias("source_start")), "again")
    later = spread_join(rest, again, ["ws"], F.struct("doc_id", "h", "start")).where("doc_id > source").withColumn("n", F.lit(LENGTH).cast("long"))
    found = functools.reduce(DataFrame.union, found).union(later.select(*columns))
    line = Window.partitionBy("doc_id", "h", "source", F.col("source_start") - F.col("start")).orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "h", "source", (F.col("source_start") - F.col("start")).alias("shift"), "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return runs.select("doc_id", "h", "start", (F.col("end") - F.col("start")).alias("n"), "source", (F.col("start") + F.col("shift")).alias("source_start"))


def repeats(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id long, text) -> the outline (doc_id, n_words, sha, original) and the repeats (doc_id, spans of h, start, n).

    Of equal texts only the first is searched: of the others every word is a repeat. The bit maps only spare the sending
    of rows that nothing will match.
    """
    outline = _originals(docs, scratch)
    first = outline.where(f"doc_id = original and n_words >= {LENGTH}").select("doc_id")
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = maximal_repeats(source, scratch, marks(first)).groupBy("doc_id").agg(F.collect_set(F.struct("h", "start", "n")).alias("spans"))
    return outline, scratch.save(found, "repeats")


def _kept(b: pa.RecordBatch, col: str, spans: pa.Array, hashes: pa.Array) -> tuple[list[str], list[int], list[str]]:
    """For each text the sha of its words, how many words its repeats cover, and the others, joined by one space."""
    w = words(b.column(col))
    text, begin = _joined(w)
    whole, removed, kept = np.frombuffer(text, np.uint8), [], []
    for (lo, hi), own, h in zip(itertools.pairwise(w.first.tolist()), spans, hashes.to_pylist(), strict=True):
        edge = np.zeros(hi - lo + 1, np.int64)
        if own.is_valid:
            at, start, n = (np.asarray(own.values.field(c)) for c in ("h", "start", "n"))
            mine = at == h
            np.add.at(edge, start[mine], 1)
            np.add.at(edge, start[mine] + n[mine], -1)
        stays = np.cumsum(edge)[: hi - lo] == 0
        removed.append(int(len(stays) - stays.sum()))
        kept.append(whole[begin[lo] : begin[hi]][np.repeat(stays, np.diff(begin[lo : hi + 1]))].tobytes()[:-1].decode())
    return _shas(w), removed, kept


def _strip(batches):
    for b in chunks(batches, "text"):
        yield record(STRIPPED, b.column("doc_id"), *_kept(b, "text", b.column("spans"), b.column("h")))


def _stripped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sha_before, n_removed and kept for each document that has a repeat."""
    near = marked(docs.where(F.col("doc_id").isNotNull()), "doc_id", marks(found.select("doc_id")))
    return near.join(found, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h"), "spans").mapInArrow(_strip, _ddl(STRIPPED)).groupBy("doc_id", "sha_before").agg(F.max(F.struct("n_removed", "kept")).alias("r")).select("doc_id", "sha_before", "r.*")


def repeat_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Every word under a window of 13 words that also starts in a document of smaller doc_id is removed, as judged on the
    input. Null texts have no words. Rows of one doc_id don't remove each other's words. A row without doc_id takes no
    part and keeps all its words. Other columns are ignored. Windows are compared word by word.
    """
    s = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    outline, found = repeats(docs, s)
    part = _stripped(docs, found).select("doc_id", F.col("sha_before").alias("sha"), F.col("n_removed").alias("some"), F.sha2("kept", 256).alias("kept_sha"))
    copy = (F.col("doc_id") > F.col("original")) & (F.col("n_words") >= LENGTH)
    return outline.join(part, ["doc_id", "sha"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, EMPTY).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated words taken out of text; the kept words are joined by one space.

    Texts without a repeat stay as they are. Texts of which nothing is left, though they had words, go. Columns stay.
    Whether a text had repeats is judged as in repeat_digests.
    """
    s = Scratch(docs.sparkSession, "strip")
    short = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    outline, found = repeats(short, s)
    copies = outline.where(f"doc_id > original and n_words >= {LENGTH}").groupBy("doc_id").agg(F.collect_set("sha").alias("shas"))
    info = s.save(found.join(copies, "doc_id", "full"), "info")
    key, spans, shas, h = (f"_{c}_{len(docs.columns)}_{s.root[-12:]}" for c in ("key", "spans", "shas", "h"))
    info = info.select(F.col("doc_id").alias(key), F.col("spans").alias(spans), F.col("shas").alias(shas))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in chunks(batches, text):
            some = np.flatnonzero(np.asarray(b.column(key).is_valid()))
            out = b.select(names)
            if not len(some):
                yield out
                continue
            part = b.take(pa.array(some))
            own, removed, kept = _kept(part, text, part.column(spans), part.column(h))
            texts, stays = out.column(text).to_pylist(), np.ones(b.num_rows, bool)
            for i, sha, n, t, gone in zip(some.tolist(), own, removed, kept, part.column(shas).to_pylist(), strict=True):
                if gone and sha in gone:
                    stays[i] = False
                elif n:
                    texts[i], stays[i] = t, bool(t)
            at = out.schema.get_field_index(text)
            yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type)).filter(pa.array(stays))

    return docs.join(info, docs[doc_id].cast("long") == info[key], "left").withColumn(h, F.xxhash64(docs[text])).mapInArrow(run, schema)
