"""Byte-level BPE with a lexicon of frequent words as a minimal acyclic transducer.

The pieces that all texts have most often are counted, encoded once and compiled into an automaton that shares prefixes and
suffixes: each arc carries how many words come before it, so that the sum along a word's path numbers the word, and the
number leads to the ids put out. The file is written to the shared folder, fetched by each executor and mapped into memory
by its workers. Pieces that aren't in it are merged exactly, by the lowest rank and then from the left, many at once. The
lexicon only saves time: ids are the same without it. Texts are cut into pieces on arrays of code points.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm._shared import Scratch, chunks, fresh, small_batches, span_hashes

FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: Words of the lexicon; the driver compiles and holds no more.
LEXICON_WORDS = 1 << 16
#: Bytes of a piece up to which pieces of one length are merged together.
SHORT = 48
#: Pieces that a task counts before it sends their counts on.
COUNTED = 400_000

LETTER, NUMBER, SPACE, OTHER = range(4)
# White space of Unicode, and letters and numbers that its version 16 added to version 15.1.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((WHITE, SPACE), (NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ..., size[i] of them, for each i after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Model:
    """A byte-level BPE file: single[byte] is the byte's id; the pair keys[k] (first id << 20 | second id, sorted) has
    rank[k], and pairs of rank r become merged[r]; spelled[spelled_at[i]:spelled_at[i + 1]] are the bytes of id i."""

    single: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path) as f:
            j = json.load(f)
        if (j["normalizer"], j["pre_tokenizer"]["type"], j["pre_tokenizer"]["add_prefix_space"], j["post_processor"], j["model"]["type"]) != (None, "ByteLevel", False, None, "BPE"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(j["model"].get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} has options that aren't known here")
        # bytes that print stand for themselves in the file, the others for the code points from 256 on
        prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
        vocab, special = j["model"]["vocab"], {t["content"]: t["id"] for t in j["added_tokens"]}
        words: dict[int, bytes] = {i: bytes(byte[c] for c in w) for w, i in vocab.items()} | {i: w.encode() for w, i in special.items()}
        spelled = [words.get(i, b"") for i in range(max(words) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        single = np.array([vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        return cls(single, keys[order], order.astype(np.int64), merged, np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(x) for x in spelled])], special)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; len(merged) if it is never merged."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.merged))

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))


@functools.lru_cache(maxsize=2)
def model(path: str = FILE) -> Model:
    return Model.read(path)


def _merge_long(m: Model, ids: list[int]) -> list[int]:
    """ids of one long piece after all merges, by a heap of (rank, place): n log n steps."""
    n, none = len(ids), len(m.merged)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank = lambda i: m.by_pair.get(ids[i] << 20 | ids[after[i]], none) if after[i] >= 0 else none
    heap = [(r, i) for i in range(n) if (r := rank(i)) < none]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        r, i = heapq.heappop(heap)
        if gone[i] or rank(i) != r:
            continue
        j = after[i]
        gone[j] = True
        ids[i], after[i] = int(m.merged[r]), after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) < none:
                heapq.heappush(heap, (r, k))
    return [x for x, g in zip(ids, gone, strict=True) if not g]


def _merge_equal(m: Model, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their ids) of pieces of one length, a row each, after all merges: every pass does one merge in each row left."""
    none, out = len(m.merged), []
    rows = np.arange(len(ids))
    rank = m.ranks(ids[:, :-1], ids[:, 1:])
    while len(rows):
        size = ids.shape[1]
        at = rank.argmin(axis=1) if size > 1 else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), at] if size > 1 else np.full(len(rows), none)
        over = best == none
        if over.any():
            out.append((rows[over], ids[over]))
            rows, ids, rank, at, best = rows[~over], ids[~over], rank[~over], at[~over], best[~over]
            if not len(rows):
                break
        k = np.arange(len(rows))
        ids[k, at] = m.merged[best]
        stays = np.ones(ids.shape, bool)
        stays[k, at + 1] = False
        ids = ids[stays].reshape(len(rows), size - 1)
        stays = np.ones(rank.shape, bool)
        stays[k, at] = False
        rank = rank[stays].reshape(len(rows), size - 2)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
        rank[left, at[left] - 1] = m.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        rank[right, at[right]] = m.ranks(ids[right, at[right]], ids[right, at[right] + 1])
    return out


def merge(m: Model, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces data[start:start + size] one after another, how many each has)."""
    found: list[np.ndarray | None] = [None] * len(start)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        if n > SHORT:
            for i in at.tolist():
                found[i] = np.array(_merge_long(m, m.single[data[start[i] : start[i] + n]].tolist()), np.int64)
            continue
        for rows, ids in _merge_equal(m, m.single[data[start[at][:, None] + np.arange(n)[None, :]]]):
            for r, x in zip(at[rows].tolist(), ids, strict=True):
                found[r] = x
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found], np.int64)


# The endings that stand apart after an apostrophe, fixed by the vocabulary's pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass
class Pieces:
    """Pieces of some texts: piece k is data[start[k]:start[k] + size[k]], text i has pieces first[i] to first[i + 1].
    special[k] is the id of a piece that is a special token, else -1."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    special: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one piece of each kind, the kind of each piece)."""
        _, some, kind = np.unique(span_hashes(self.data, self.start, self.start + self.size), return_index=True, return_inverse=True)
        alike = some[kind]
        same = (self.size == self.size[alike]).all() and (self.data[_spread(self.start, self.size)] == self.data[_spread(self.start[alike], self.size)]).all()
        if not same:  # two pieces of one hash: by their bytes
            seen: dict[bytes, int] = {}
            kind = np.array([seen.setdefault(self.data[a : a + n].tobytes(), len(seen)) for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)], np.int64)
            some = np.unique(kind, return_index=True)[1]
        return some, kind


def pieces(texts: list[str], special: dict[str, int]) -> Pieces:
    """Texts cut at special tokens, then into runs of letters, of numbers and of other marks, each with one space before it
    if there is one, endings after an apostrophe, and runs of white space less what goes with the next piece."""
    parts, ids, n_parts = [], [], []
    # of special tokens that begin in one place the longest counts
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    for t in texts:
        some = [x for x in (cut.split(t) if cut else [t]) if x]
        parts += some
        ids += [special.get(x, -1) for x in some]
        n_parts.append(len(some))
    joined = "".join(parts)
    data = np.frombuffer(joined.encode(), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    part_at = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    first_part = np.r_[0, np.cumsum(n_parts)].astype(np.int64)
    kind = classes()[points]
    fresh_part = np.zeros(n + 1, bool)
    fresh_part[part_at] = True
    begins = fresh_part.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # white space before something in the same part: its last character stands apart, and a plain space joins what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh_part[1:n])
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    tick = np.flatnonzero((points[:-1] == 39) & begins[: n - 1] & (kind[1:] == LETTER) & ~fresh_part[1:n]) if n else last
    for e in ENDINGS:
        ok = tick[tick + len(e) < n]
        for k, c in enumerate(e):
            ok = ok[(points[ok + 1 + k] == ord(c)) & ~fresh_part[ok + 1 + k]]
        begins[ok + 1] = False
        begins[ok + 1 + len(e)] = True
    marked = np.array(ids, np.int64)
    for p in np.flatnonzero(marked >= 0).tolist():
        begins[part_at[p] + 1 : part_at[p + 1]] = False
    start = np.flatnonzero(begins[:n])
    byte_at = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))].astype(np.int64)
    at = np.r_[byte_at[start], byte_at[n]]
    part = np.searchsorted(part_at, start, side="right") - 1
    return Pieces(data, at[:-1], np.diff(at), np.searchsorted(start, part_at[first_part]), marked[part] if len(part) else np.zeros(0, np.int64))


class Lexicon:
    """A minimal acyclic automaton over words that numbers them, and the ids of each number, as views of one flat array."""

    def __init__(self, flat: np.ndarray):
        n_arcs, n_states, n_words, n_ids, self.root, self.longest = flat[:6].tolist()
        cuts = np.cumsum([6, n_arcs, n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids])
        self.state, self.label, self.to, self.skip, self.final, self.at, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        # arcs are sorted by state and label
        self.key = self.state.astype(np.int64) << 8 | self.label

    @staticmethod
    def compiled(words: dict[bytes, list[int]]) -> np.ndarray:
        """The flat array of the words and their ids."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def settled(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        # path has the states of the last word that may still get arcs: those behind what it shares with the next are settled
        path: list[list] = [[False, []]]
        last = b""
        ordered = sorted(words)
        for w in [*ordered, b""]:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            while len(path) > k + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settled(node)))
            path += [[False, []] for _ in w[k:]]
            path[-1][0] |= w in words
            last = w
        root = settled(path[0])
        count = np.zeros(len(states), np.int64)
        arcs = []
        for i, (final, out) in enumerate(states):
            total = int(final)
            for label, to in out:
                arcs.append((i, label, to, total))
                total += int(count[to])
            count[i] = total
        table = np.array(arcs, np.int32).reshape(-1, 4)
        ids = [words[w] for w in ordered]
        head = [len(table), len(states), len(ids), sum(map(len, ids)), root, max(map(len, ordered), default=0)]
        at = np.r_[0, np.cumsum([len(x) for x in ids])]
        return np.concatenate([np.array(head), *table.T, [int(s[0]) for s in states], at, np.array([i for x in ids for i in x])]).astype(np.int32)

    def numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is not in the lexicon."""
        number = np.full(len(start), -1, np.int64)
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        if not len(self.key):
            return number
        state, total, k = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64), 0
        while len(at):
            key = state << 8 | data[start[at] + k]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            at, arc, total = at[ok], arc[ok], total[ok]
            state, total, k = self.to[arc].astype(np.int64), total + self.skip[arc], k + 1
            ends = (size[at] == k) & (self.final[state] == 1)
            number[at[ends]] = total[ends]
            on = size[at] > k
            at, state, total = at[on], state[on], total[on]
        return number


def encode(m: Model, lexicon: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, where each text's begin and end)."""
    p = pieces(texts, m.special)
    some, kind = p.distinct() if len(p.start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    start, size, special = p.start[some], p.size[some], p.special[some]
    number = np.where(special >= 0, -1, lexicon.numbers(p.data, start, size))
    known, odd, new = np.flatnonzero(number >= 0), np.flatnonzero(special >= 0), np.flatnonzero((number < 0) & (special < 0))
    at = lexicon.at.astype(np.int64)[number[known]]
    many = np.zeros(len(some), np.int64)
    many[known], many[odd] = lexicon.at[number[known] + 1] - at, 1
    merged, many[new] = merge(m, p.data, start[new], size[new])
    ids = np.concatenate([lexicon.ids[_spread(at, many[known])], special[odd], merged]).astype(np.int32)
    begin = np.zeros(len(some), np.int64)
    order = np.r_[known, odd, new]
    begin[order] = np.cumsum(many[order]) - many[order]
    out = ids[_spread(begin[kind], many[kind])]
    return out, np.r_[0, np.cumsum(many[kind])][p.first]


def decode(m: Model, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The text of each stretch of ids. Ids that the file doesn't have stand for nothing, bytes that are no UTF-8 for U+FFFD."""
    ids = np.where((ids >= 0) & (ids < len(m.spelled_at) - 1), ids, len(m.spelled_at) - 1)
    at = np.r_[m.spelled_at, m.spelled_at[-1]]
    n = np.diff(at)[ids]
    data = m.spelled[_spread(at[:-1][ids], n)].tobytes()
    cuts = np.r_[0, np.cumsum(n)][bounds].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def frequent_pieces(docs: DataFrame, most: int = LEXICON_WORDS, text: str = "text", path: str = FILE) -> DataFrame:
    """(piece as bytes, n) of the pieces that all texts together have most often; ties by bytes.

    Tasks count before they send. What is sorted in one place are the most frequent and those within a sixteenth of a power
    of two of them, as often as the last that is taken.
    """
    special = model(path).special

    def count(batches):
        total: dict[bytes, int] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

        for b in chunks(batches, "text"):
            p = pieces([t or "" for t in b.column("text").to_pylist()], special)
            if not len(p.start):
                continue
            some, kind = p.distinct()
            data = p.data.tobytes()
            for a, n, k, s in zip(p.start[some].tolist(), p.size[some].tolist(), np.bincount(kind).tolist(), p.special[some].tolist(), strict=True):
                if s < 0 and n <= SHORT:  # a longer one is no word, and has a way of its own
                    w = data[a : a + n]
                    total[w] = total.get(w, 0) + k
            if len(total) > COUNTED:
                yield sent()
                total = {}
        yield sent()

    s = Scratch(docs.sparkSession, "pieces")
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "piece binary, n long")
    counted = s.save(counted.groupBy("piece").agg(F.sum("n").alias("n")), "counted")
    # from how often on there are enough: only these meet in one task, and not the most of each
    level = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, 0
    for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("pieces")).orderBy(F.desc("level")).collect():
        left, least = left - r.pieces, r.level
        if left <= 0:
            break
    return counted.where(level >= least).orderBy(F.desc("n"), "piece").limit(most)


def published(spark: SparkSession, words: DataFrame, path: str = FILE) -> str:
    """The name of a lexicon file of these pieces, which tasks open with opened(). At most LEXICON_WORDS rows are taken."""
    m = model(path)
    got = [bytes(w) for w in words.select("piece").limit(LEXICON_WORDS).toArrow().column("piece").to_pylist()]
    size = np.array([len(w) for w in got], np.int64)
    ids, n = merge(m, np.frombuffer(b"".join(got), np.uint8), np.cumsum(size) - size, size)
    flat = Lexicon.compiled(dict(zip(got, [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])], strict=True)) if got else {})
    s = Scratch(spark, "lexicon")
    name = f"{s.root.rsplit('/', 1)[-1]}.bin"
    fs, place = s._path(f"{s.root}/{name}")
    out = fs.create(place)
    out.write(bytearray(flat.tobytes()))
    out.close()
    spark.sparkContext.addFile(f"{s.root}/{name}")
    return name


@functools.lru_cache(maxsize=4)
def opened(name: str) -> Lexicon:
    """The lexicon file of that name, mapped into memory; workers of one executor share its pages."""
    return Lexicon(np.memmap(SparkFiles.get(name), np.int32, "r"))


def encoded(docs: DataFrame, keep: list[str], lexicon: str | None = None, text: str = "text", path: str = FILE) -> DataFrame:
    """The columns keep of docs and tokens, the ids of each text as the file at path gives them, in the rows of docs.

    lexicon: the name that published() gave for pieces of other texts; else those of docs are counted first, in one more
    pass. Special tokens of the file count as such where they stand in a text; none are added. Null counts as empty and has
    no tokens. Repeated rows come back as often; a table without rows gives none. Other columns stay out, and one of keep
    that bears the name tokens gives way to it. A piece of any length takes n log n steps.
    """
    spark = small_batches(docs.sparkSession)
    m = spark.sparkContext.broadcast(model(path))
    name = lexicon or published(spark, frequent_pieces(docs, text=text, path=path), path)
    keep = [c for c in keep if c.lower() != "tokens"]
    own = fresh("tokens", docs.select(*keep))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in chunks(batches, own):
            ids, bounds = encode(m.value, opened(name), [t or "" for t in b.column(own).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))], names=[*keep, "tokens"])

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def decoded(encodings: DataFrame, keep: list[str], tokens: str = "tokens", path: str = FILE) -> DataFrame:
    """The columns keep of encodings and text, what its tokens spell, special tokens included.

    Null tokens give a null text, none an empty one; ids that the file doesn't have, and nulls among the ids, spell nothing.
    One of keep that bears the name text gives way to it.
    """
    m = small_batches(encodings.sparkSession).sparkContext.broadcast(model(path))
    keep = [c for c in keep if c.lower() != "text"]
    own = fresh("ids", encodings.select(*keep))
    schema = T.StructType([*encodings.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            lists = b.column(own)
            ids = np.asarray(pa.compute.fill_null(lists.flatten(), -1), np.int64)
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            texts = decode(m.value, ids, np.r_[0, np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], names=[*keep, "text"])

    return encodings.select(*keep, F.col(tokens).cast("array<int>").alias(own)).mapInArrow(run, schema)
