"""Descriptive statistics, correlation, reliability, density and errors.

Aggregates are column expressions with the library's conventions: an empty mean is NaN, a deviation of fewer than two
values is NaN, a correlation with a constant is 0. NaN values are taken as they are; nulls are skipped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, finite, nan_unless, ratio
from tidewave.operators.grouped import summary, table
from tidewave.operators.series import ID, X, over
from tidewave.plans.selection import percentiles


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(NAN))


def std(x: Column) -> Column:
    """Population deviation; NaN for fewer than two values."""
    return nan_unless(F.count(x) >= 2, F.stddev_pop(x))


def std_sample(x: Column) -> Column:
    return nan_unless(F.count(x) >= 2, F.stddev_samp(x))


def cv(x: Column) -> Column:
    """Population deviation over the mean's size; NaN where the mean is 0."""
    return nan_unless((F.count(x) >= 2) & (F.avg(x) != 0), F.try_divide(F.stddev_pop(x), F.abs(F.avg(x))))


def median(x: Column) -> Column:
    """The median as an aggregate; a task holds a group's different values. For few large groups: percentiles()."""
    return F.coalesce(F.percentile(x, 0.5), F.lit(NAN))


def percentile(x: Column, p: float) -> Column:
    """Percentile p (0 to 100) by linear interpolation, as an aggregate like median()."""
    return F.coalesce(F.percentile(x, p / 100), F.lit(NAN))


def mad(df: DataFrame, by: str = ID, x: str = X) -> DataFrame:
    """Median of the distances from the median, by group, for groups of any size; the medians are joined back in between."""
    mid = percentiles(df, [by], x, {"_m": 0.5})
    away = df.join(mid, by).select(by, F.abs(F.col(x) - F.col("_m")).alias("_d"))
    return percentiles(away, [by], "_d", {"mad": 0.5})


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r; 0 if either is constant or there are fewer than two pairs."""
    r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y), 0.0)
    return F.when((F.count(x) >= 2) & finite(r), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all ordered pairs of columns, from one aggregation; 1 on the diagonal."""
    aggs = [pearson(F.col(a), F.col(b)).alias(f"r_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    cell = lambda i, j: F.lit(1.0) if i == j else F.col(f"r_{min(i, j)}_{max(i, j)}")
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(i, j).alias("r")) for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return (df.agg(*aggs) if aggs else df.limit(1)).select(F.explode(rows).alias("c")).select("c.*")


def acf(df: DataFrame, max_lag: int, unbiased: bool = False, normalized: bool = True) -> DataFrame:
    """(series_id, lag, acf): autocovariance about the mean at lags 0 to max_lag, over that at 0 if normalized.

    Each lag is a window shift and an aggregation; a constant series has 0 at every lag.
    """
    m = F.avg(X).over(Window.partitionBy(ID))
    d = df.withColumns({"_d": F.col(X) - m, "_n": F.count(F.lit(1)).over(Window.partitionBy(ID))})
    lags = [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(max_lag + 1)]
    d = d.select(ID, "_d", "_n", *[(F.lag("_d", k).over(over()) if k else F.col("_d")).alias(f"_l{k}") for k in range(max_lag + 1)])
    a = d.groupBy(ID).agg(F.first("_n").alias("n"), *lags)
    cov = lambda k: F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / ((F.greatest(F.col("n") - k, F.lit(1))) if unbiased else F.col("n"))
    value = lambda k: ratio(cov(k), cov(0), 0.0) if normalized else cov(k)
    a = a.select(ID, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), value(k).alias("acf")) for k in range(max_lag + 1)])).alias("c"))
    return a.select(ID, "n", "c.lag", "c.acf").where("lag < n").drop("n")


def ccf(df: DataFrame, driver: str, target: str, max_lag: int) -> DataFrame:
    """(series_id, lag, r): Pearson's r of the driver lag samples ago with the target now."""
    d = df.select(ID, F.col(target).alias("_t"), *[(F.lag(driver, k).over(over()) if k else F.col(driver)).alias(f"_d{k}") for k in range(max_lag + 1)])
    both = lambda k: F.when(F.col(f"_d{k}").isNotNull() & F.col("_t").isNotNull(), F.col("_t"))
    a = d.groupBy(ID).agg(*[pearson(F.when(both(k).isNotNull(), F.col(f"_d{k}")), both(k)).alias(f"r{k}") for k in range(max_lag + 1)])
    return a.select(ID, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(max_lag + 1)])).alias("c")).select(ID, "c.*")


def variability(df: DataFrame) -> DataFrame:
    """One row per series of intervals: sdnn (population), rmssd, mean and deviation of successive absolute differences.

    rmssd is NaN below three intervals; with divisor n - 1 it is the root mean square of the differences.
    """
    d = F.col(X) - F.lag(X).over(over())
    s = df.select(ID, X, d.alias("_d"))
    return s.groupBy(ID).agg(
        std(F.col(X)).alias("sdnn"),
        nan_unless(F.count(X) >= 3, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd"),
        mean(F.abs("_d")).alias("mean_successive"),
        std(F.col("_d")).alias("sd_successive"),
    )


def errors(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates of a regression report: mae, mse, rmse, bias, max_abs_error, r2 (0 for a constant y that is missed, 1 if met)."""
    e = y - p
    rss, tss = F.sum(e * e), F.var_pop(y) * F.count(y)
    return {
        "n": F.count(e),
        "mae": mean(F.abs(e)),
        "mse": mean(e * e),
        "rmse": F.sqrt(mean(e * e)),
        "bias": mean(e),
        "max_abs_error": F.coalesce(F.max(F.abs(e)), F.lit(NAN)),
        "r2": F.when(tss > 0, 1 - F.try_divide(rss, tss)).otherwise(F.when(rss == 0, 1.0).otherwise(0.0)),
    }


def distances(a: Column, b: Column) -> dict[str, Column]:
    """Of two equally long arrays: euclidean, manhattan, chebyshev and cosine distance (1 if either has no length)."""
    pair = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    total = lambda f: F.aggregate(pair, F.lit(0.0), lambda s, p: s + f(p["x"], p["y"]))
    dot, na, nb = total(lambda x, y: x * y), total(lambda x, y: x * x), total(lambda x, y: y * y)
    return {
        "euclidean": F.sqrt(total(lambda x, y: (x - y) * (x - y))),
        "manhattan": total(lambda x, y: F.abs(x - y)),
        "chebyshev": F.aggregate(pair, F.lit(0.0), lambda s, p: F.greatest(s, F.abs(p["x"] - p["y"]))),
        "cosine": 1 - ratio(dot, F.sqrt(na * nb), 0.0),
    }


def icc(df: DataFrame, subject: str = "subject", rater: str = "rater", y: str = "y") -> DataFrame:
    """One row: the six Shrout-Fleiss coefficients of a balanced table; all 1 if every value is the same."""
    n, k = F.countDistinct(subject), F.countDistinct(rater)
    total = df.agg(n.alias("n"), k.alias("k"), F.avg(y).alias("g"), F.min(y).alias("lo"), F.max(y).alias("hi"))
    by_s = df.groupBy(subject).agg(F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    by_r = df.groupBy(rater).agg(F.avg(y).alias("m"))
    s = by_s.agg(F.var_pop("m").alias("vs"), F.avg("v").alias("vw"))
    r = by_r.agg(F.var_pop("m").alias("vr"))
    t = total.join(F.broadcast(s)).join(F.broadcast(r)).withColumns({"n": F.col("n").cast("double"), "k": F.col("k").cast("double")})
    t = t.withColumns({"b": F.col("n") * F.col("k") * F.col("vs") / (F.col("n") - 1), "w": F.col("n") * F.col("k") * F.col("vw") / (F.col("n") * (F.col("k") - 1)), "j": F.col("n") * F.col("k") * F.col("vr") / (F.col("k") - 1)})
    t = t.withColumn("e", (F.col("w") * F.col("n") * (F.col("k") - 1) - F.col("j") * (F.col("k") - 1)) / ((F.col("n") - 1) * (F.col("k") - 1)))
    b, w, j, e, kk, nn = (F.col(c) for c in ("b", "w", "j", "e", "k", "n"))
    forms = {
        "icc_11": ratio(b - w, b + (kk - 1) * w),
        "icc_1k": ratio(b - w, b),
        "icc_21": ratio(b - e, b + (kk - 1) * e + kk * (j - e) / nn),
        "icc_2k": ratio(b - e, b + (j - e) / nn),
        "icc_31": ratio(b - e, b + (kk - 1) * e),
        "icc_3k": ratio(b - e, b),
    }
    return t.select(*[F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(v).alias(c) for c, v in forms.items()])


def histogram(df: DataFrame, bins: int, by: str | None = None, x: str = X) -> DataFrame:
    """(bin, left, right, count), empty bins too: equal widths over the finite values' range, the last bin closed.

    A value's place is its share of the range times (bins - 1e-12), cut down to a whole number. A constant has one bin.
    """
    keys = [by] if by else []
    d = df.where(finite(F.col(x)))
    rng = d.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rng = rng.withColumn("bins", F.when(F.col("hi") > F.col("lo"), bins).otherwise(1))
    joined = d.join(F.broadcast(rng) if not by else rng, keys) if by else d.join(F.broadcast(rng))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("bins") - 1e-12))).otherwise(0).cast("int")
    counts = joined.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def silverman(x: np.ndarray) -> float:
    """1.06 min(sd, IQR / 1.34) n^(-1/5), quartiles by nearest rank, at least a thousandth of the span."""
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if n < 2:
        return 1.0
    rank = lambda p: x[min(max(int(round(p * (n - 1))), 0), n - 1)]
    sd, iqr = x.std(), (rank(0.75) - rank(0.25)) / 1.34
    spread = min(v for v in (sd, iqr) if v > 0) if max(sd, iqr) > 0 else 0.0
    return max(1.06 * spread * n**-0.2, (x[-1] - x[0]) * 1e-3) or 1.0


def kde(df: DataFrame, points: int = 80, pad: float = 0.05, bandwidth: float | None = None) -> DataFrame:
    """(series_id, at, density): Gaussian kernel density on a uniform grid, a share pad wider than the data at each end."""

    def run(x: np.ndarray) -> dict:
        x = x[np.isfinite(x)]
        if not len(x):
            return {"at": [], "density": []}
        h, span = bandwidth or silverman(x), x.max() - x.min()
        grid = np.linspace(x.min() - pad * (span or 1), x.max() + pad * (span or 1), points)
        total = np.zeros(points)
        for a in range(0, len(x), 10_000):
            total += np.exp(-0.5 * ((grid[:, None] - x[None, a : a + 10_000]) / h) ** 2).sum(axis=1)
        return {"at": grid, "density": total / (len(x) * h * np.sqrt(2 * np.pi))}

    return table(df, run, "at double, density double")


def kde_counts(df: DataFrame, bins: int, points: int = 80, pad: float = 0.05, bandwidth: float | None = None) -> DataFrame:
    """(series_id, at, density, count): the density, and how many values a histogram's bin there would be expected to hold.

    The bins are those of histogram() by series: the range over their number. Of a constant series, whose one bin has no
    width, count is the density; a series without finite values has no rows.
    """
    g = df.where(finite(F.col(X))).groupBy(ID).agg(F.count(X).alias("_n"), ((F.max(X) - F.min(X)) / bins).alias("_w"))
    d = kde(df, points, pad, bandwidth).join(g, ID)
    return d.select(ID, "at", "density", F.when(F.col("_w") > 0, F.col("density") * F.col("_n") * F.col("_w")).otherwise(F.col("density")).alias("count"))


def bandpower(f: np.ndarray, psd: np.ndarray, lo: float, hi: float) -> float:
    """Trapezoidal integral of psd over [lo, hi], with the edges interpolated; NaN where the bands don't meet."""
    lo, hi = max(lo, f[0]) if len(f) else lo, min(hi, f[-1]) if len(f) else hi
    if not len(f) or hi <= lo:
        return NAN
    inner = (f > lo) & (f < hi)
    at = np.r_[lo, f[inner], hi]
    return float(np.trapezoid(np.interp(at, f, psd), at))


# names used by callers that summarise series
describe_kernel = lambda x: {"n": len(x), "mean": float(np.mean(x)) if len(x) else NAN, "std": float(np.std(x)) if len(x) > 1 else NAN, "mad": float(np.median(np.abs(x - np.median(x)))) if len(x) else NAN}


def describe(df: DataFrame) -> DataFrame:
    return summary(df, describe_kernel, "n long, mean double, std double, mad double")
