"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch of texts are laid one after another and indexed by a suffix array. Every piece of the
vocabulary is looked up in it by binary search; its range of suffixes gives its occurrences, which are edges from a
start to an end. The edges are sorted by position and relaxed from left to right. The vocabulary is of the merging kind:
a piece may follow another one only if merging both together would leave exactly these two, and of each prefix just one
last piece fulfils that, so relaxing keeps for each place the one edge that may follow the piece kept at its start.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm._shared import chunks, mix, small_batches, value_hashes
from tidewave.llm.vocabulary import MARK, PIECES, pieces

#: The suffix array tells suffixes apart by so many characters; no piece may be longer.
LONGEST = 16
#: Pairs of pieces that a worker remembers.
CACHE = 1 << 20
#: Bytes of text that are indexed at once; more of them hold fewer distinct stretches each.
BATCH_BYTES = 1 << 20


#: How often the tables of a vocabulary were made in this process.
made = 0


class Vocabulary:
    """Tables of a vocabulary's pieces (text, score), made once on the driver and sent to all tasks.

    What is small or slow to make is kept as arrays and pickled; the tables that follow from them at once are made on first
    use and stay with the object, which a Python worker keeps from task to task as long as its broadcast is in use.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.byte_ids = np.array([i for i, (p, _) in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")], np.int64)
        special = {i for i, (p, _) in enumerate(pieces) if p in ("<unk>", "<s>", "</s>")} | set(self.byte_ids.tolist())
        self.ids = np.array([i for i in range(len(pieces)) if i not in special], np.int32)
        text = [pieces[i][0] for i in self.ids.tolist()]
        if max(map(len, text)) > LONGEST or len(self.byte_ids) != 256:
            raise ValueError(f"a vocabulary with byte pieces and no piece of over {LONGEST} characters is needed")
        #: Code k + 2 stands for the k-th of these; 0 for none, 1 for a character that is no piece.
        self.chars = np.array(sorted({ord(c) for p in text for c in p}), np.int64)
        self.length = np.array([len(p) for p in text])
        points = np.frombuffer("".join(p.ljust(LONGEST, "\0") for p in text).encode("utf-32-le"), np.uint32).reshape(-1, LONGEST)
        self.key = np.where(np.arange(LONGEST) < self.length[:, None], np.searchsorted(self.chars, points) + 2, 0).astype(np.uint16)
        self.order = np.argsort(np.argsort([-pieces[i][1] for i in self.ids.tolist()], kind="stable"))
        self.single = np.full(len(self.chars) + 2, -1)
        one = np.flatnonzero(self.length == 1)
        self.single[self.key[one, 0]] = one
        if (self.single[2:] < 0).any():
            raise ValueError("each character of a piece must be a piece itself")
        of_text = {p: k for k, p in enumerate(text)}
        joins = [(of_text[p[:j]], of_text[p[j:]], k) for k, p in enumerate(text) for j in range(1, len(p)) if p[:j] in of_text and p[j:] in of_text]
        left, right, whole = (np.array(x) for x in zip(*joins, strict=True))
        key = left * len(text) + right
        at = np.argsort(key)
        self.join_key, self.join_to = key[at], whole[at]
        spelled = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            spelled[i] = bytes([b])
        for i, (p, _) in enumerate(pieces):
            if p in ("<s>", "</s>"):
                spelled[i] = b""
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.r_[0, np.cumsum([len(s) for s in spelled])]
        #: Whether merging a piece's own text gives the piece; one that can't come about is no edge.
        self.alone = np.concatenate([self._whole(np.arange(a, min(a + 4000, len(text)))) for a in range(0, len(text), 4000)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "touching", "known", "bounds")}

    @functools.cached_property
    def table(self) -> np.ndarray:
        """The code of each code point; 1 for a character that is no piece."""
        global made
        made += 1
        out = np.ones(sys.maxunicode + 1, np.uint16)
        out[self.chars] = np.arange(len(self.chars)) + 2
        return out

    @functools.cached_property
    def touching(self) -> np.ndarray:
        """Whether a code may be followed by another within a piece."""
        out = np.zeros((len(self.chars) + 2,) * 2, bool)
        inner = self.key[:, 1:] > 0
        out[self.key[:, :-1][inner], self.key[:, 1:][inner]] = True
        return out

    @functools.cached_property
    def known(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(CACHE, -1, np.int64), np.zeros(CACHE, bool)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.ids) + right
        at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
        return np.where(self.join_key[at] == key, self.join_to[at], -1)

    def settle(self, tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row's first size tokens until no two of them merge; tokens has a column of -1 behind them."""
        live, size = np.arange(len(tokens)), size.copy()
        none = len(self.ids) + 1
        while len(live):
            w = int(size[live].max())
            t = tokens[live, : w + 1]
            ok = t[:, 1:] >= 0
            to = np.full(ok.shape, -1)
            to[ok] = self.merged(t[:, :-1][ok], t[:, 1:][ok])
            rank = np.where(to >= 0, self.order[to], none)
            best = rank.argmin(axis=1)
            rows = np.flatnonzero(rank[np.arange(len(live)), best] < none)
            live, best = live[rows], best[rows]
            if len(live):
                new = to[rows, best]
                shift = np.arange(w)[None, :] > best[:, None]
                t = t[rows]
                tokens[live, :w] = np.where(shift, t[:, 1:], t[:, :-1])
                tokens[live, best] = new
                tokens[live, w] = -1
                size[live] -= 1
        return tokens, size

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of left and right, from single characters, ends with just these two."""
        tokens = np.full((len(left), 2 * LONGEST + 1), -1)
        for k in range(LONGEST):
            at = np.flatnonzero(self.length[left] > k)
            tokens[at, k] = self.single[self.key[left[at], k]]
            at = np.flatnonzero(self.length[right] > k)
            tokens[at, self.length[left[at]] + k] = self.single[self.key[right[at], k]]
        tokens, size = self.settle(tokens, self.length[left] + self.length[right])
        return (size == 2) & (tokens[:, 0] == left)

    def _whole(self, piece: np.ndarray) -> np.ndarray:
        tokens = np.full((len(piece), LONGEST + 1), -1)
        there = np.arange(LONGEST) < self.length[piece][:, None]
        tokens[:, :LONGEST][there] = self.single[self.key[piece][there]]
        tokens, size = self.settle(tokens, self.length[piece])
        return (size == 1) & (tokens[:, 0] == piece)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stable() with a memory of fixed size."""
        keys, values = self.known
        key = left * len(self.ids) + right
        slot = (mix(key.astype(np.uint64)) & np.uint64(CACHE - 1)).astype(np.int64)
        miss = np.flatnonzero(keys[slot] != key)
        out = values[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            good = np.concatenate([self.stable(new[a : a + 20000] // len(self.ids), new[a : a + 20000] % len(self.ids)) for a in range(0, len(new), 20000)])
            out[miss] = good[back]
            values[slot[miss]] = good[back]
            keys[slot[miss]] = key[miss]
        return out

    @functools.cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the least and the greatest packed text that begins with it."""
        high = self.key.copy()
        high[np.arange(LONGEST)[None, :] >= self.length[:, None]] = 0xFFFF
        return _pack(self.key), _pack(high)


def _pack(key: np.ndarray) -> np.ndarray:
    """Rows of 16 codes as rows of 4 integers of the same order."""
    k = key.reshape(len(key), LONGEST // 4, 4).astype(np.uint64)
    return k[:, :, 0] << np.uint64(48) | k[:, :, 1] << np.uint64(32) | k[:, :, 2] << np.uint64(16) | k[:, :, 3]


def _below(a: np.ndarray, b: np.ndarray, also_equal: bool) -> np.ndarray:
    out = np.full(len(a), also_equal)
    for k in range(a.shape[1] - 1, -1, -1):
        out = (a[:, k] < b[:, k]) | ((a[:, k] == b[:, k]) & out)
    return out


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of the 16 codes from each on, those codes packed). codes ends with 16 zeros or more."""
    n = len(codes) - LONGEST
    c = codes.astype(np.uint64)
    four = c[: n + 12] << np.uint64(48) | c[1 : n + 13] << np.uint64(32) | c[2 : n + 14] << np.uint64(16) | c[3 : n + 15]
    packed = np.stack([four[4 * k : n + 4 * k] for k in range(4)], axis=1)
    # a rank of the first 4 codes, then of 8 and of 16, each from two of the last
    values, rank = np.unique(four, return_inverse=True)
    for step in (4, 8):
        pair = rank[:-step].astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
    order = np.argsort(rank[:n])
    return order, packed[order]


def occurrences(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every piece."""
    order, packed = suffix_array(codes)
    low, high = v.bounds
    ends = []
    for bound, also_equal in ((low, False), (high, True)):
        lo, hi = np.zeros(len(bound), np.int64), np.full(len(bound), len(order))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            go = _below(packed[np.minimum(mid, len(order) - 1)], bound, also_equal) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, mid)
        ends.append(lo)
    n = ends[1] - ends[0]
    piece = np.repeat(np.arange(len(n)), n)
    return order[np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[0], n)], piece


def relax(v: Vocabulary, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all stretches one after another, how many each has). A zero stands between the stretches."""
    start, piece = occurrences(v, codes)
    ok = v.alone[piece]
    start, piece = start[ok], piece[ok]
    stretch = np.repeat(np.arange(len(first)), length + 1)
    size = v.length[piece]
    till = start - first[stretch[start]] + size
    # by how far into its stretch an edge ends, then by place, the longest first
    order = np.argsort((till.astype(np.int64) << 36) + (start + size << 5) + (LONGEST - size))
    start, piece, till = start[order], piece[order], till[order]
    end = start + v.length[piece]
    last, count = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
    steps = np.searchsorted(till, np.arange(1, int(length.max(initial=0)) + 2))
    opening = np.zeros(len(codes), bool)
    opening[first] = True
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        s, p, e = start[a:b], piece[a:b], end[a:b]
        while len(s):
            head = np.r_[True, e[1:] != e[:-1]]
            hs, hp, he = s[head], p[head], e[head]
            good = opening[hs].copy()
            inner = np.flatnonzero(~good)
            good[inner] = v.may_follow(last[hs[inner]], hp[inner])
            last[he[good]] = hp[good]
            count[he[good]] = count[np.where(opening[hs], 0, hs)[good]] * ~opening[hs][good] + 1
            rest = ~head & (last[e] < 0)
            s, p, e = s[rest], p[rest], e[rest]
    # back from the ends
    at = first + length
    n = count[at]
    to = np.cumsum(n)
    out = np.full(int(n.sum()), -1)
    live = np.arange(len(first))
    while len(live):
        here = at[live]
        out[to[live] - n[live] + count[here] - 1] = last[here]
        at[live] = here - v.length[last[here]]
        live = live[at[live] > first[live]]
    return out, n


def encode(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, where each text's begin and end)."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    n = len(points)
    begin = np.r_[0, np.cumsum([len(t) for t in marked])]
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    code = v.table[points]
    cut = np.ones(n, bool)
    cut[1:] = ~v.touching[code[:-1], code[1:]]
    cut[begin[:-1][np.diff(begin) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], n]
    h = value_hashes(mix(points.astype(np.uint64) + np.uint64(1)), start, end)
    _, some, which = np.unique(h, return_index=True, return_inverse=True)
    s, length = start[some], (end - start)[some]
    unknown = code[s] == 1
    # characters that are no piece stand alone and are spelled in bytes
    ids_of: list[np.ndarray] = []
    known = np.flatnonzero(~unknown)
    size = length[known]
    first = np.cumsum(size + 1) - size - 1
    laid = np.zeros(int((size + 1).sum()) + LONGEST, np.uint16)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    laid[np.repeat(first, size) + inner] = code[np.repeat(s[known], size) + inner]
    got, n_got = relax(v, laid, first, size) if len(known) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    odd = np.flatnonzero(unknown)
    spelled = [v.byte_ids[list(chr(p).encode())] for p in points[s[odd]].tolist()]
    ids_of = np.concatenate([v.ids[got], *spelled]).astype(np.int32)
    many = np.zeros(len(some), np.int64)
    many[known] = n_got
    many[odd] = [len(x) for x in spelled]
    at = np.zeros(len(some), np.int64)
    at[known] = np.cumsum(n_got) - n_got
    at[odd] = len(got) + np.cumsum(many[odd]) - many[odd]
    k = many[which]
    out_at = np.cumsum(k) - k
    out = ids_of[np.arange(int(k.sum())) - np.repeat(out_at - at[which], k)]
    bounds = np.r_[out_at, len(out)][np.searchsorted(start, begin)]
    return out, bounds


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The UTF-8 of each text: pieces are joined, the mark is a space, and the space put before the text goes."""
    n = np.diff(v.spelled_at)[ids]
    at = np.cumsum(n) - n
    text = v.spelled[np.arange(int(n.sum())) - np.repeat(at - v.spelled_at[ids], n)].tobytes()
    cuts = np.r_[at, len(text)][bounds].tolist()
    return [text[a + (text[a : a + 1] == b" ") : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = PIECES) -> Vocabulary:
    """The tables of the vocabulary at path, made once in the driver."""
    return Vocabulary(pieces(path))


ENCODED = pa.schema([("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encoded(docs: DataFrame, keep: list[str], text: str = "text", path: str = PIECES) -> DataFrame:
    """The columns keep of docs, and n_tokens, tokens and round_trip of each text, in the rows of docs.

    tokens are ids of the vocabulary at path. round_trip: whether decoding gives the text again, byte by byte; a text that
    holds the mark itself comes back with spaces. Null has null tokens and no round trip, an empty text has none of either
    kind but is decoded rightly. Repeated rows come back as often. Only text is looked at; other columns stay out, and one
    of keep that bears a name of the three results gives way to it.
    """
    v = small_batches(docs.sparkSession).sparkContext.broadcast(vocabulary(path))
    keep = [c for c in keep if c.lower() not in ENCODED.names]
    source = docs.select(*keep, F.col(text).alias("tokens"))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *added])

    def run(batches):
        for b in chunks(batches, "tokens", BATCH_BYTES):
            texts = b.column("tokens").to_pylist()
            there = [t is not None for t in texts]
            ids, bounds = encode(v.value, [t or "" for t in texts])
            back = decode(v.value, ids, bounds)
            same = [ok and t.encode() == d for ok, t, d in zip(there, texts, back, strict=True)]
            mask = pa.array([not x for x in there])
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask if not all(there) else None)
            counts = pa.array(np.diff(bounds), pa.int64(), mask=~np.array(there))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], counts, tokens, pa.array(same)], names=[*keep, *ENCODED.names])

    return source.mapInArrow(run, schema)
