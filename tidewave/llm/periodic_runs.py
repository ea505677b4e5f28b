"""Periodic runs of words by Main and Lorentz's divide and conquer.

The words of a text are interned as numbers. A text is halved again and again; a run (a stretch of smallest period q that no
neighbouring word extends) lies whole in the first part whose midpoint it crosses. Of a run with at least four periods,
one half holds a square that begins or ends at the midpoint, so the Z-function of the right half and that of the left half
read backwards find it: at q the Z-function has q or more. What is found is extended over the midpoint; the same
interval found from both sides or at a multiple of its period counts once, with its smallest period. All texts of a batch
are halved together, level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm._shared import chunks, fresh, small_batches

#: Words of a square that are compared for all places at once, before the few places left are compared one by one.
TOGETHER = 8
#: Below so many periods a run may hold no square at the midpoint.
LEAST_EXPONENT = 4


class _Numbers(dict):
    """Numbers for words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _shared(x: np.ndarray, a: int, b: int, most: int) -> int:
    """How many of at most so many values from a on equal those from b on."""
    done, step = 0, 32
    while done < most:
        k = min(step, most - done)
        differ = x[a + done : a + done + k] != x[b + done : b + done + k]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + k, step * 4
    return most


def _places(x: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, p) where the first words of x[mid:hi] and of x[mid + p:hi] agree, up to TOGETHER words of those needed."""
    half = (hi - mid) // 2
    seg = np.repeat(np.arange(len(mid)), half)
    p = np.arange(len(seg)) - np.repeat(np.cumsum(half) - half, half) + 1
    need = np.maximum(p, -(-least // 2) - p)
    ok = mid[seg] + p + need <= hi[seg]
    for k in range(TOGETHER):
        at = np.flatnonzero(ok & (need > k)) if k else np.flatnonzero(ok)
        if not len(at):
            break
        ok[at] = x[mid[seg[at]] + k] == x[mid[seg[at]] + p[at] + k]
        if k == 0:  # most places are gone
            seg, p, need = seg[ok], p[ok], need[ok]
            ok = ok[ok]
    return seg[ok], p[ok]


def _squares(y: np.ndarray, ps: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(p, Z of y at p) of the smallest periods p of y that reach so far that a run may begin with y; ps: places to look at.

    Z-function with its box: within the box values come from the box's begin, and comparing goes on only beyond its end.
    """
    out, known, left, right, reach, i = [], {}, 0, 0, 0, 0
    while i < len(ps):
        p = int(ps[i])
        same = known.get(p - left, -1) if p < right else -1
        if 0 <= same < right - p:
            z = same
        else:
            begin = right - p if same >= 0 else 0
            z = begin + _shared(y, begin, p + begin, len(y) - p - begin)
            if p + z > right:
                left, right = p, p + z
        known[p] = z
        i += 1
        if z >= max(p, -(-least // 2) - p):
            out.append((p, z))
            # a square within reach of this period has no smallest period of its own
            reach = p + z
            i = max(i, int(np.searchsorted(ps, reach // 2 + 1)))
    return out


def _crossing(x: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) within their segments of the runs that cross a midpoint and hold a square after it."""
    seg, p = _places(x, mid, hi, least)
    out = []
    cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = seg[a]
        m, low, high = int(mid[s]), int(lo[s]), int(hi[s])
        back = x[low:high][::-1]
        for q, z in _squares(x[m:high], p[a:b], least):
            end = m + q + z
            start = m - _shared(back, high - m, high - m - q, m - low)
            if end - start >= max(least, exponent * q):
                out.append((start, end, q))
    return out


def find_runs(x: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of some sequences, by text, start and period.

    Sequence i is x[first[i]:first[i + 1]]. A run has at least so many values and so many periods.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods are not looked for")
    lo, hi, n, found = first[:-1].astype(np.int64), first[1:].astype(np.int64), len(x), []
    back = x[::-1]
    while len(lo):
        keep = hi - lo >= max(least, exponent)
        lo, hi = lo[keep], hi[keep]
        mid = (lo + hi) // 2
        found += _crossing(x, lo, mid, hi, least, exponent)
        found += [(n - e, n - s, q) for s, e, q in _crossing(back, n - hi, n - mid, n - lo, least, exponent)]
        lo, hi = np.r_[lo, mid], np.r_[mid, hi]
    if not found:
        return np.zeros((0, 4), np.int64)
    start, end, q = np.array(found, np.int64).T
    text = np.searchsorted(first, start, side="right") - 1
    # a run that goes on beyond its segment was found whole in a larger one
    ok = ((start == first[text]) | (x[start - 1] != x[start - 1 + q])) & ((end == first[text + 1]) | (x[np.minimum(end, n - 1)] != x[end - q]))
    start, end, q, text = start[ok], end[ok], q[ok], text[ok]
    order = np.lexsort((q, end, start))
    start, end, q, text = start[order], end[order], q[order], text[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    rows = np.stack([text, start - first[text], end - start, q], axis=1)[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = 6, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The columns keep of docs, and n_words, runs and collapsed of each text, in the rows of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. runs has (start, length, period) of each run of at least `least` words
    and `exponent` (4 or more) periods, by start, then period. collapsed joins by one space the words that no run holds
    after its first period. Null and empty texts have no words, no runs and an empty collapsed. Runs that overlap or share
    a start are all there; equal intervals count once, with their smallest period. Repeated rows come back as often.
    Only text is looked at; one of keep that bears a name of the three results gives way to it. A text is one task's work
    and takes n log n steps at most but for the squares at a midpoint, of which there are at most log n.
    """
    source_name = fresh("words", docs)
    keep = [c for c in keep if c.lower() not in ("n_words", "runs", "collapsed")]
    source = small_batches(docs.sparkSession) and docs.select(*keep, F.col(text).alias(source_name))
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for b in chunks(batches, source_name):
            split = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in b.column(source_name)]
            first = np.r_[0, np.cumsum([len(w) for w in split])]
            numbers = _Numbers()
            ids = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, int(first[-1]))
            found = find_runs(ids, first, least, exponent)
            dropped = np.zeros(len(ids) + 1, np.int64)
            begin = first[found[:, 0]] + found[:, 1]
            np.add.at(dropped, begin + found[:, 3], 1)
            np.add.at(dropped, begin + found[:, 2], -1)
            gone = np.cumsum(dropped[:-1]) > 0
            texts = []
            some = set(found[:, 0].tolist())
            for i, ws in enumerate(split):
                texts.append(b" ".join([w for w, g in zip(ws, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g] if i in some else ws))
            bounds = np.searchsorted(found[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in (1, 2, 3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), rows), pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "runs", "collapsed"],
            )

    return source.mapInArrow(run, schema)
