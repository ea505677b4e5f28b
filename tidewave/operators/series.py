"""Operators on long series: (series_id, i, x), one row per sample, ordered by i within a series.

All are expressions over windows partitioned by series, or folds over one series' array; none gathers several series in
a task. Rows with a null x count as NaN unless said otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, finite, nan_unless

ID, AT, X = "series_id", "i", "x"


def over(frame: tuple[int, int] | None = None, id_: str | list[str] = ID, at: str | list[str] = AT):
    w = Window.partitionBy(*([id_] if isinstance(id_, str) else id_)).orderBy(*([at] if isinstance(at, str) else at))
    return w.rowsBetween(*frame) if frame else w


def successive_differences(df: DataFrame, absolute: bool = False) -> DataFrame:
    """One row per sample but a series' first: x less the last x."""
    d = F.col(X) - F.lag(X).over(over())
    return df.withColumns({"diff": F.abs(d) if absolute else d, "_k": F.row_number().over(over())}).where("_k > 1").drop("_k")


def rolling_mean(df: DataFrame, k: int, name: str = "mean") -> DataFrame:
    """Mean of the last k samples, NaN until there are k; k = 1 is x itself and k = 0 is NaN throughout."""
    if k < 1:
        return df.withColumn(name, F.lit(NAN))
    w = over((-(k - 1), 0))
    return df.withColumn(name, nan_unless(F.count(F.lit(1)).over(w) == k, F.avg(X).over(w)))


def rolling_std(df: DataFrame, k: int, name: str = "std") -> DataFrame:
    """Population deviation of the last k samples, NaN until there are k, and throughout for k <= 1."""
    if k <= 1:
        return df.withColumn(name, F.lit(NAN))
    w = over((-(k - 1), 0))
    return df.withColumn(name, nan_unless(F.count(F.lit(1)).over(w) == k, F.stddev_pop(X).over(w)))


def _fold(df: DataFrame, step, out: str, first=None) -> DataFrame:
    """A recursion over each series in order: out[0] = first(x0) and out[k] = step(out[k-1], x[k]).

    One series' values are folded in one pass over its array, which an executor holds.
    """
    seed = first or (lambda x: x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(AT)
        x, y = pdf[X].to_numpy(float), np.empty(len(pdf))
        for k in range(len(x)):
            y[k] = seed(x[k]) if k == 0 else step(y[k - 1], x[k])
        return pdf.assign(**{out: y})

    return df.groupBy(ID).applyInPandas(run, df.withColumn(out, F.lit(0.0)).schema)


def ewma(df: DataFrame, span: int, name: str = "ewma") -> DataFrame:
    """Exponentially weighted mean, seeded by the first sample, with weight 2 / (span + 1)."""
    a = 2.0 / (span + 1)
    return _fold(df, lambda last, x: a * x + (1 - a) * last, name)


def sliding_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """series_id, start and the array of each full window of size samples, every step samples."""
    w = over((0, size - 1))
    at = F.row_number().over(over()) - 1
    out = df.select(ID, at.alias("start"), F.collect_list(F.coalesce(X, F.lit(NAN))).over(w).alias("window"))
    return out.where((F.size("window") == size) & (F.col("start") % step == 0))


def rolling_apply(df: DataFrame, size: int, step: int, fn) -> DataFrame:
    """sliding_windows with value = fn(array column)."""
    return sliding_windows(df, size, step).select(ID, "start", fn(F.col("window")).alias("value"))


def time_windows(df: DataFrame, length: float, step: float, time: str = "t") -> DataFrame:
    """(series_id, lo, hi): row ranges [lo, hi) of windows of length seconds that start at the first time and go on by step.

    Windows lie at the data, not at the epoch. A window is given if it starts no later than the last sample and holds some.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[time].to_numpy(float))
        if not len(t) or not (length > 0 and step > 0):
            return pd.DataFrame({ID: [], "lo": [], "hi": []})
        starts = t[0] + step * np.arange(int(np.floor((t[-1] - t[0]) / step)) + 1)
        lo, hi = np.searchsorted(t, starts), np.searchsorted(t, starts + length)
        ok = hi > lo
        return pd.DataFrame({ID: pdf[ID].iloc[0], "lo": lo[ok], "hi": hi[ok]})

    return df.groupBy(ID).applyInPandas(run, f"{ID} {dict(df.dtypes)[ID]}, lo long, hi long")


def discretize(x: Column, cuts: list[float]) -> Column:
    """How many of the increasing cuts are no greater than x; 0 for what is not finite."""
    return F.when(finite(x), sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))).otherwise(0)


def cumtrapz(df: DataFrame, dx: float, name: str = "area") -> DataFrame:
    """Running trapezoidal integral, 0 at the first sample."""
    part = F.coalesce((F.col(X) + F.lag(X).over(over())) / 2 * dx, F.lit(0.0))
    return df.withColumn("_part", part).withColumn(name, F.sum("_part").over(over((Window.unboundedPreceding, 0)))).drop("_part")


def trapz(df: DataFrame, dx: float, name: str = "area") -> DataFrame:
    """One integral per series; 0 for a series of one sample."""
    part = F.coalesce((F.col(X) + F.lag(X).over(over())) / 2 * dx, F.lit(0.0))
    return df.select(ID, part.alias("_part")).groupBy(ID).agg(F.sum("_part").alias(name))


def circular(angle: Column) -> dict[str, Column]:
    """Aggregates of angles in radians: circular mean, resultant length and circular deviation, of the finite ones.

    The mean is null where the resultant is under 1e-12, and the deviation too; all are null without finite angles.
    """
    a = F.when(finite(angle), angle)
    c, s = F.avg(F.cos(a)), F.avg(F.sin(a))
    r = F.least(F.hypot(c, s), F.lit(1.0))
    return {
        "circular_mean": F.when(r >= 1e-12, F.atan2(s, c)),
        "resultant_length": r,
        "circular_sd": F.when(r > 1e-12, F.sqrt(F.greatest(F.lit(-2.0) * F.ln(r), F.lit(0.0)))),
    }


def rk4(f, t0: float, t1: float, y0, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Fixed steps of the classical fourth-order method from t0 to t1, the last one shortened to end at t1."""
    t, y, out = t0, np.asarray(y0, float), [(t0, np.asarray(y0, float))]
    while t < t1 - 1e-12:
        h = min(dt, t1 - t)
        a = f(t, y)
        b = f(t + h / 2, y + h / 2 * a)
        c = f(t + h / 2, y + h / 2 * b)
        d = f(t + h, y + h * c)
        y = y + h / 6 * (a + 2 * b + 2 * c + d)
        t += h
        out.append((t, y))
    return np.array([x for x, _ in out]), np.stack([v for _, v in out])


def gradient(f, x, eps: float = 1e-6) -> np.ndarray:
    """Central differences."""
    x = np.asarray(x, float)
    e = np.eye(len(x)) * eps
    return np.array([(f(x + d) - f(x - d)) / (2 * eps) for d in e])


def gradient_descent(f, x0, grad=None, rate: float = 0.1, tol: float = 1e-8, most: int = 1000) -> dict:
    """Descent with halved steps where the value would rise; ends when the gradient or the change is under tol."""
    x, value = np.asarray(x0, float), float(f(np.asarray(x0, float)))
    for k in range(most):
        g = np.asarray(grad(x) if grad else gradient(f, x), float)
        if np.linalg.norm(g) < tol:
            return {"x": x, "value": value, "iterations": k, "converged": True}
        h = rate
        while h > 1e-14 and not (new := float(f(x - h * g))) < value:
            h /= 2
        if h <= 1e-14 or value - new < tol * 1e-4:
            return {"x": x, "value": value, "iterations": k, "converged": True}
        x, value = x - h * g, new
    return {"x": x, "value": value, "iterations": most, "converged": False}


def golden_section(f, lo: float, hi: float, tol: float = 1e-8, most: int = 200, maximum: bool = False) -> dict:
    """The least (or greatest) point of a unimodal function on [lo, hi]."""
    g = (lambda v: -f(v)) if maximum else f
    r = (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    ga, gb, k = g(a), g(b), 0
    while hi - lo > tol and k < most:
        if ga <= gb:
            hi, b, gb = b, a, ga
            a = hi - r * (hi - lo)
            ga = g(a)
        else:
            lo, a, ga = a, b, gb
            b = lo + r * (hi - lo)
            gb = g(b)
        k += 1
    x = (lo + hi) / 2
    return {"x": x, "value": f(x), "iterations": k}
