"""Quality classifier: naive Bayes support vectors.

A text's features are the n-grams that occur in it, of bytes and of word shapes, hashed. Each indicator is scaled by the
log ratio of its smoothed counts in the two classes; a linear hinge-loss model is fitted to the scaled vectors by dual
coordinate descent, and its margins are turned into probabilities by a logistic curve fitted on held-back folds.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import Words, chunks, mix, small_batches, words

BITS = 18
SIZE = 1 << BITS
BYTE_GRAMS, SHAPE_GRAMS = (1, 2, 3), (1, 2, 3, 4)
#: About so many labelled documents are drawn by a hash of the id; fewer: all.
MAX_TRAIN = 4000
EPOCHS, COST, FOLDS = 12, 1.0, 3

_KIND = np.zeros(256, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[33:48], _KIND[58:65], _KIND[91:97], _KIND[123:127] = 16, 16, 16, 16


def _shapes(w: Words) -> np.ndarray:
    """For each word: which kinds of bytes it has, its first and last kind, its length up to 12, whether it repeats the last word."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    cut = np.stack([w.start, w.end], axis=1).ravel()
    kinds = _KIND[w.data]
    seen = np.bitwise_or.reduceat(np.append(kinds, np.uint64(0)), cut)[::2]
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = np.minimum((w.end - w.start) // 3, 4).astype(np.uint64)
    return seen | kinds[w.start] << np.uint64(8) | kinds[w.end - 1] << np.uint64(16) | size << np.uint64(24) | again.astype(np.uint64) << np.uint64(32)


def features(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashed n-grams of each text."""
    w = words(texts)
    shapes, n_bytes = _shapes(w), len(w.data)
    data = w.data.astype(np.uint64)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    off = np.r_[0, np.cumsum(sizes)]
    grams = []
    for n in BYTE_GRAMS:
        m = max(n_bytes - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h << np.uint64(8) | data[k : m + k]
        grams.append((n, (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)))
    for n in SHAPE_GRAMS:
        m = max(len(shapes) - n + 1, 0)
        h = np.full(m, 1000 + n, np.uint64)
        for k in range(n):
            h = mix(h + shapes[k : m + k])
        grams.append((n, (h >> np.uint64(64 - BITS)).astype(np.int64)))
    mark, out = np.zeros(SIZE, bool), []
    for i, ((a, b), (c, d)) in enumerate(zip(itertools.pairwise(off.tolist()), itertools.pairwise(w.first.tolist()), strict=True)):
        for n, h in grams[: len(BYTE_GRAMS)]:
            mark[h[a : max(a, b - n + 1)]] = True
        for n, h in grams[len(BYTE_GRAMS) :]:
            mark[h[c : max(c, d - n + 1)]] = True
        out.append(np.flatnonzero(mark))
        mark[out[i]] = False
    return out


def log_ratios(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.ones(SIZE), np.ones(SIZE)]
    for f, label in zip(x, y.tolist(), strict=True):
        counts[label][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def margin(f: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    r = ratio[f]
    return float(w[f] @ r / max(np.sqrt(r @ r), 1e-12) + bias) if len(f) else bias


def fit_hinge(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over unit-length scaled vectors, by dual coordinate descent."""
    rows = [(f, (r := ratio[f]) / max(np.sqrt(r @ r), 1e-12)) for f in x]
    w, bias, alpha, sign = np.zeros(SIZE), 0.0, np.zeros(len(x)), np.where(y == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)).tolist():
            f, v = rows[i]
            new = min(max(alpha[i] - (sign[i] * (w[f] @ v + bias) - 1) / 2.0, 0.0), COST)  # vector and bias have length 1 each
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps, with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        q = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-3]]), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(x: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(weights with the ratios in them, the ratios' squares' root per text aside; bias; slope; offset)."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return np.zeros((2, SIZE)), 0.0, 1.0, float(np.log(share / (1 - share)))
    fold = np.arange(len(y)) % FOLDS
    held = np.zeros(len(y))
    for k in range(FOLDS):
        inner = [i for i in range(len(y)) if fold[i] != k]
        part = y[inner]
        if len(set(part.tolist())) == 2:
            some = [x[i] for i in inner]
            ratio = log_ratios(some, part)
            w, bias = fit_hinge(some, part, ratio)
            held[fold == k] = [margin(x[i], ratio, w, bias) for i in np.flatnonzero(fold == k)]
    ratio = log_ratios(x, y)
    w, bias = fit_hinge(x, y, ratio)
    return np.stack([ratio, w]), bias, *logistic(held, y)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", most: int = MAX_TRAIN):
    """The model from documents with a label of 0 or 1, joined by id; labels are drawn before the join, most of them or so.

    Of several labels of one id the more frequent counts, of as many 0 as 1 the 1. Documents that share an id are examples
    each. Rows without id or label take no part; without any example every score is 0.5. Other columns are ignored. The draw of at most a few thousand ids is what is sent to all tasks; one task fits the model to their features.
    """
    small_batches(documents.sparkSession)
    there = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((2 * F.sum(F.col(label).cast("int")) >= F.count("*")).cast("int").alias("y"))
    n = there.count()
    drawn = there.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < min(1.0, most / max(n, 1)) * 1_000_003)
    source = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")

    def extract(batches):
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "y": b.column("y"), "f": pa.array([f.astype(np.int32).tobytes() for f in features(b.column("text"))], pa.binary())})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "f"])
        table, bias, slope, offset = fit([np.frombuffer(f, np.int32) for f in pdf.f], pdf.y.to_numpy(np.int64))
        return pd.DataFrame({"table": [table.astype(np.float32).tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    got = source.mapInArrow(extract, "id long, y int, f binary").groupBy(F.lit("all")).applyInPandas(solve, "table binary, bias double, slope double, offset double").collect()
    if not got:
        return np.zeros((2, SIZE), np.float32), 0.0, 1.0, 0.0
    return np.frombuffer(got[0].table, np.float32).reshape(2, SIZE), got[0].bias, got[0].slope, got[0].offset


def scored(docs: DataFrame, model, keep: list[str], text: str = "text", cut: float = 0.3) -> DataFrame:
    """The columns keep of docs, score (0 to 1) and predicted (score >= cut) of each whole text; null counts as empty.

    Every row comes back once, repeated rows as often. A column of keep that is named like a result gives way to it.
    """
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    m = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("score"))
    schema = docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        table, bias, slope, offset = m.value
        weights, squares = (table[0] * table[1]).astype(np.float64), table[0].astype(np.float64) ** 2
        for b in chunks(batches, "score"):
            raw = np.array([weights[f].sum() / max(np.sqrt(squares[f].sum()), 1e-12) + bias if len(f) else bias for f in features(b.column("score"))])
            score = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)
