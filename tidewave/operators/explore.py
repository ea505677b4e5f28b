"""Small transforms for looking at signals, matching of detected events, coupling of two event series, work logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import biosignals, dynamics, signal
from tidewave.operators.grouped import table
from tidewave.operators.series import AT, ID, X, over


def moving_average(df: DataFrame, half: int, name: str = "y") -> DataFrame:
    """Mean of the samples within half to each side, of fewer at the ends."""
    return df.withColumn(name, F.avg(X).over(over((-half, half))))


def median_filter(df: DataFrame, half: int, name: str = "y") -> DataFrame:
    """Median of the samples within half to each side, of fewer at the ends."""
    return df.withColumn(name, F.percentile(X, 0.5).over(over((-half, half))))


def detrend_mean(df: DataFrame, name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(X) - F.avg(X).over(Window.partitionBy(ID)))


def derivatives(df: DataFrame) -> DataFrame:
    """d1: the difference from the last sample, 0 for the first; d2: the same of d1."""
    d = df.withColumn("d1", F.coalesce(F.col(X) - F.lag(X).over(over()), F.lit(0.0)))
    return d.withColumn("d2", F.coalesce(F.col("d1") - F.lag("d1").over(over()), F.lit(0.0)))


def matches(found: DataFrame, known: DataFrame, tolerance: int) -> DataFrame:
    """(series_id, known, matched): how many known events have a found one within the tolerance of samples."""
    cell = lambda c: F.floor(F.col(c) / (tolerance + 1))
    f = found.select(ID, F.col(AT).alias("_f"), F.explode(F.array(cell(AT) - 1, cell(AT), cell(AT) + 1)).alias("_c"))
    k = known.select(ID, F.col(AT).alias("_k"), cell(AT).alias("_c"))
    hit = k.join(f, [ID, "_c"], "left").groupBy(ID, "_k").agg(F.max(F.when(F.abs(F.col("_k") - F.col("_f")) <= tolerance, 1).otherwise(0)).alias("hit"))
    return hit.groupBy(ID).agg(F.count(F.lit(1)).alias("known"), F.sum("hit").alias("matched"))


def detect_ecg(df: DataFrame, fs: float) -> DataFrame:
    """(series_id, t, prominence) of R peaks: two band-pass sections of 5 to 15 Hz, 0.2 s apart at least, prominence 0.2."""

    def run(x: np.ndarray) -> dict:
        y = signal.bandpass(signal.bandpass(x, fs, 5.0, min(15.0, fs * 0.45)), fs, 5.0, min(15.0, fs * 0.45))
        at, prom = signal.find_peaks(y, prominence=0.2, distance=max(int(round(0.2 * fs)), 1))
        return {"t": at / fs, "prominence": prom}

    return table(df, run, "t double, prominence double")


def coupling(a: np.ndarray, b: np.ndarray) -> dict:
    """Correlation, cross sample entropy and mutual information of the last intervals of two series, as many of each."""
    n = min(len(a), len(b))
    a, b = a[len(a) - n :], b[len(b) - n :]
    if n < 4 or a.std() == 0 or b.std() == 0:
        return {"n": n, "r": 0.0, "xsampen": 0.0, "mi": 0.0}
    za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    return {"n": n, "r": float((za * zb).mean()), "xsampen": dynamics.cross_sample_entropy(za, zb, 2, 0.2), "mi": dynamics.mutual_information(a, b, 4)}


def pair_coupling(df: DataFrame, pairs: DataFrame, end: float, length: float = biosignals.WINDOW_S) -> DataFrame:
    """(a, b, n, r, xsampen, mi) of stated pairs of series of events (series_id, t, interval) in (end - length, end]."""
    kind = dict(df.dtypes)[ID]
    w = df.where((F.col("t") > end - length) & (F.col("t") <= end)).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("t", "interval"))).alias("v"))
    j = pairs.join(w.select(F.col(ID).alias("a"), F.col("v").alias("va")), "a").join(w.select(F.col(ID).alias("b"), F.col("v").alias("vb")), "b")
    j = j.select("a", "b", F.transform("va", lambda s: s["interval"]).alias("va"), F.transform("vb", lambda s: s["interval"]).alias("vb"))

    def run(it):
        for pdf in it:
            rows = [coupling(np.asarray(u, float), np.asarray(v, float)) for u, v in zip(pdf.va, pdf.vb, strict=True)]
            yield pd.concat([pdf[["a", "b"]], pd.DataFrame(rows, columns=["n", "r", "xsampen", "mi"])], axis=1)

    return j.mapInPandas(run, f"a {kind}, b {kind}, n long, r double, xsampen double, mi double")


#: The states of a work log's queries and attempts.
QUERY_STATES, ATTEMPT_STATES = ("open", "done", "abandoned"), ("running", "succeeded", "failed")


def finish(log: DataFrame, id_: int, state: str, states: tuple[str, ...] = QUERY_STATES) -> DataFrame:
    """log with the row of that id in a final state; a row that is in one already stays."""
    if state not in states[1:]:
        raise ValueError(f"one of {states[1:]} is needed")
    return log.withColumn("status", F.when((F.col("id") == id_) & (F.col("status") == states[0]), state).otherwise(F.col("status")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, t in sorted(tables.items()):
        row = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def ring_statistics(df: DataFrame, capacity: int) -> DataFrame:
    """(series_id, n, mean, last) of the last samples of each series, no more than capacity."""
    w = Window.partitionBy(ID).orderBy(F.desc(AT))
    d = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= capacity)
    return d.groupBy(ID).agg(F.count(X).alias("n"), F.avg(X).alias("mean"), F.max_by(X, AT).alias("last"))


def scrimmage(per_side: int = 11, seconds: int = 180, dt: float = 1.0, seed: int = 0) -> pd.DataFrame:
    """series_id, t, agent_id, grp, x, y of two sides that sway about their places on a pitch of 105 by 68 m."""
    rng, t = np.random.default_rng(seed), np.arange(0, seconds, dt)
    rows = []
    for side in (0, 1):
        home = np.stack([rng.uniform(-50, 10, per_side) * (1 if side == 0 else -1), rng.uniform(-32, 32, per_side)], 1)
        for k, (x, y) in enumerate(home):
            phase = rng.uniform(0, 2 * np.pi, 2)
            rows.append(pd.DataFrame({"series_id": "play", "t": t, "agent_id": side * per_side + k, "grp": side, "x": np.clip(x + 8 * np.sin(t / 20 + phase[0]), -52.5, 52.5), "y": np.clip(y + 5 * np.cos(t / 15 + phase[1]), -34, 34)}))
    return pd.concat(rows, ignore_index=True)
