"""Exact top-k search by inner product over a bit-sliced index.

Each component of the quantised vectors, less the block's least value, is kept as bit maps, one for each binary digit, a
bit for each row. A query's score is a sum of components times whole numbers; written in signed binary digits, that is a
sum of shifted slices, or of their complements, which full adders of bitmap operations add up. The top rows are chosen
from the most significant slice of the sum downward; rows that tie at the boundary are resolved by their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch

#: Rows of an index block (a slice of one is 2 KB) and queries of a query block.
ROWS, QUERIES = 16384, 256
SCALE = 256
#: Components must be smaller: beyond it, 256 times a double no longer tells whole numbers apart.
MOST = float(1 << 44)

BLOCK = "block int, ids binary, low binary, slices binary, n_slices int, dims int"
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """(id, x array<long>): floor(256 * x) for vectors that are there and whose components are there and finite.

    A component of MOST or more either way is an error: no score with it could be told from others of its size.
    """
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = lambda v: F.when(F.abs(v) < MOST, F.floor(v * SCALE).cast("long")).otherwise(F.raise_error(F.concat(F.lit("a component is too large to be quantised: "), v.cast("string"))).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, whole).alias("x"))


def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids ascending, least value of each component, slices[component, digit, words])."""
    pdf = pdf.sort_values("id", kind="stable")
    m = np.stack(pdf.x.to_list()).astype(np.int64)
    low = m.min(axis=0)
    m -= low
    n_slices = max(int(m.max(initial=0)).bit_length(), 1)
    pad = -len(m) % 64
    m = np.concatenate([m, np.zeros((pad, m.shape[1]), np.int64)])
    bits = [np.ascontiguousarray(np.packbits((m.T >> b & 1).astype(np.uint8), axis=1, bitorder="little")).view(np.uint64) for b in range(n_slices)]
    return pdf.id.to_numpy(np.int64), low, np.stack(bits, axis=1).reshape(m.shape[1], n_slices, -(-len(m) // 64))


def _digits(w: int) -> list[tuple[int, int]]:
    """w as (place, 1 or -1) with no two places next to each other."""
    out, k = [], 0
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((k, d))
            w -= d
        w >>= 1
        k += 1
    return out


def add_slices(slices: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of the sum of w times the components, from the least up; what to add to it, for the complements).

    A negative digit takes the complement of a component, (2 ** n - 1) - x, in place of -x.
    """
    dims, n, words = slices.shape
    flat = np.concatenate([slices.reshape(dims * n, words), ~slices.reshape(dims * n, words)])
    places, rows, shift = [], [], 0
    for d, value in enumerate(w.tolist()):
        for k, sign in _digits(value):
            if sign < 0:
                shift -= ((1 << n) - 1) << k
            for b in range(n):
                places.append(k + b)
                rows.append(d * n + b + (dims * n if sign < 0 else 0))
    places, rows = np.array(places, int), np.array(rows, int)
    out, carried, c = [], None, 0
    while c <= (places.max() if len(places) else -1) or carried is not None:
        now = flat[rows[places == c]]
        if carried is not None:
            now = np.concatenate([now, carried])
        carries = []
        while len(now) > 1:
            m = len(now) // 3
            if m:
                x, y, z = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                either = x ^ y
                carries.append((x & y) | (either & z))
                now = np.concatenate([either ^ z, now[3 * m :]])
            else:
                carries.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        carried = np.concatenate(carries) if carries else None
        c += 1
    return out, shift


def top(total: list[np.ndarray], there: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of the greatest sums, of equal ones those that come first."""
    sure, tied, n_sure = np.zeros_like(there), there, 0
    for s in reversed(total):
        high = tied & s
        n = int(np.bitwise_count(high).sum())
        if n_sure + n > k:
            tied = high
        else:
            sure, n_sure, tied = sure | high, n_sure + n, tied & ~s
            if n_sure == k:
                break
    place = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate([place(sure), place(tied)[: k - n_sure]])


def search(ids: np.ndarray, low: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best rows of the block, rows of the query's own id left out."""
    words = slices.shape[2]
    all_there = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    out = []
    for q, w in zip(query_ids.tolist(), queries, strict=True):
        total, shift = add_slices(slices, w)
        there = all_there
        a, b = np.searchsorted(ids, q), np.searchsorted(ids, q, "right")
        if a < b:
            own = np.zeros(words * 64, np.uint8)
            own[a:b] = 1
            there = all_there & ~np.packbits(own, bitorder="little").view(np.uint64)
        base = shift + sum(int(a) * int(b) for a, b in zip(w, low, strict=True))
        for r in top(total, there, k).tolist():
            score = base + sum(((int(s[r >> 6]) >> (r & 63)) & 1) << i for i, s in enumerate(total))
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"the score of {q} and {int(ids[r])}, {score}, is no long")
            out.append((q, int(ids[r]), score))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank from 1, vec_id and score: for each row whose id is divisible by every, its k best other rows.

    The score is the inner product of floor(256 * x), exact for whatever size: components of 2 ** 44 or more and scores that
    are no long are errors. Vectors that are null or hold null or non-finite components take no part. Vectors are compared
    with those of the same length, empty ones with score 0. Other columns are ignored. Equal scores go to the smaller id; repeated ids are candidates as
    often as they are there, but never for a query of that id; a query row that is repeated is answered once. Rows and
    queries are dealt to blocks by a hash of their ids, so equal vectors are no skew; blocks of queries meet every block
    of rows once, and only k rows of each meeting go on.
    """
    s = Scratch(vectors.sparkSession, "slices")
    q = quantised(vectors, vec, vec_id)
    n = q.count()
    n_blocks, q_blocks = max(1, -(-n // ROWS)), max(1, -(-n // (QUERIES * every)))

    def index(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, low, slices = build(pdf)
        return pd.DataFrame([(key[0], ids.tobytes(), low.tobytes(), slices.tobytes(), slices.shape[1], key[1])], columns=["block", "ids", "low", "slices", "n_slices", "dims"])

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], pdf.id.to_numpy(np.int64).tobytes(), np.stack(pdf.x.to_list()).astype(np.int64).tobytes())], columns=["q_block", "q_dims", "q_ids", "q_x"])

    rows = q.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"), "dims": F.size("x")})
    blocks = s.save(rows.groupBy("block", "dims").applyInPandas(index, BLOCK), "blocks")
    asked = q.where(F.col("id") % every == 0).dropDuplicates(["id"]).withColumns({"q_block": F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"), "q_dims": F.size("x")})
    asked = s.save(asked.groupBy("q_block", "q_dims").applyInPandas(pack, "q_block int, q_dims int, q_ids binary, q_x binary"), "queries")
    # each block of queries is sent to every block of rows; the key spreads the pairs
    sent = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = sent.join(blocks, (F.col("b") == F.col("block")) & (F.col("q_dims") == F.col("dims"))).drop("b", "q_dims", "block")
    met = met.repartition(max(1, min(n_blocks * q_blocks, 4096)))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                ids, low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["n_slices"], -(-len(ids) // 64))
                found = search(ids, low, slices, np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_x"], np.int64).reshape(len(row["q_ids"]) // 8, row["dims"]), k)
                cols = zip(*found, strict=True) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=RESULT)

    # a row holds a whole index block
    best = s.save(met.mapInArrow(run, "query_id long, vec_id long, score long"), "best", batch_rows=8)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
