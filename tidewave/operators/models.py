"""Fits beyond one aggregation: polynomial search, nonlinear models, splits, evaluation policies, discretising.

Sums by group or by term are gathered by Spark; what is solved on the driver or in a group has the size of the model.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.special import chi2_sf, normal_cdf
from tidewave.operators.classification import gram

#: The linear congruential generator that splits and k-means seeding use, and the least size of a part.
LCG_A, LCG_C, MIN_ROWS, MIN_SHARE = 1664525, 1013904223, 10, 0.1


def lcg(seed: int):
    while True:
        seed = (seed * LCG_A + LCG_C) % 2**64
        yield seed


def shuffled(n: int, seed: int) -> array:
    """0 to n - 1 in the order of a Fisher-Yates shuffle driven by the generator."""
    order, draw = array("q", range(n)), lcg(seed)
    for last in range(n - 1, 0, -1):
        k = next(draw) % (last + 1)
        order[last], order[k] = order[k], order[last]
    return order


def split_sizes(n: int, test_share: float) -> tuple[int, int]:
    """(training, test) rows: the rounded share, within [1, n - 1]; refused if a part would be under 10 rows or a tenth."""
    test = min(max(math.floor(test_share * n + 0.5), 1), n - 1)
    least = max(MIN_ROWS, math.ceil(MIN_SHARE * n))
    if min(test, n - test) < least:
        raise ValueError(f"parts of at least {least} rows are needed")
    return n - test, test


#: Rows that one task numbers.
NUMBERED = 100_000


def _placed(df: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """df with _at, 0 to n - 1: places in the order of a seeded hash of the columns order, then of these themselves.

    Rows are dealt to ranges of the hash; only the ranges' sizes meet in one task.
    """
    parts = max(1, -(-n // NUMBERED))
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), *order).bitwiseAND((1 << 62) - 1))
    d = d.withColumn("_b", F.floor(F.col("_h") / ((1 << 62) / parts)))
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *order)) - 1
    return d.join(sizes.select("_b", base.alias("_base")), "_b").withColumn("_at", F.col("_base") + own).drop("_b", "_h", "_base")


def train_test_split(df: DataFrame, order: list[str], test_share: float, seed: int = 42, folds: int = 0) -> DataFrame:
    """df with part and fold. Rows are shuffled by a seeded hash of the columns order, the first go to training.

    Parts have exactly the sizes of split_sizes; folds of training rows are contiguous in the shuffled order and differ by
    one row at most. Rows alike in all columns of order are told apart by chance.
    """
    n = df.count()
    train, _ = split_sizes(n, test_share)
    d = _placed(df, order, n, seed).withColumn("part", F.when(F.col("_at") < train, "train").otherwise("test"))
    if folds:
        base, extra = divmod(train, folds)
        first = extra * (base + 1)
        d = d.withColumn("fold", F.when(F.col("part") == "train", F.when(F.col("_at") < first, F.floor(F.col("_at") / (base + 1))).otherwise(extra + F.floor((F.col("_at") - first) / max(base, 1)))).cast("int"))
    return d.drop("_at")


def repeated_train_test_split(df: DataFrame, order: list[str], test_share: float, repeats: int, seed: int = 42) -> DataFrame:
    """df once for each repeat, with repeat and part; each repeat has a seed of its own."""
    n = df.count()
    train, _ = split_sizes(n, test_share)
    parts = [_placed(df, order, n, seed + k).withColumns({"repeat": F.lit(k), "part": F.when(F.col("_at") < train, "train").otherwise("test")}).drop("_at") for k in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped_split(df: DataFrame, group: str, test_share: float, seed: int = 42) -> DataFrame:
    """df with part, every group whole in one of them: groups are shuffled like rows and the last share of them tested."""
    groups = df.select(group).distinct()
    n = groups.count()
    test = max(1, min(n - 1, math.floor(test_share * n + 0.5)))
    chosen = _placed(groups, [group], n, seed).where(F.col("_at") >= n - test).select(group, F.lit(True).alias("_t"))
    return df.join(chosen, group, "left").withColumn("part", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def fit_scores(n: int, rss: float, tss: float, k: int) -> dict:
    """r2, adjusted r2, AIC and BIC (up to constants) of a Gaussian linear model with k coefficients."""
    r2 = 1 - rss / tss if tss > 0 else 0.0
    ll = n * math.log(max(rss / n, 1e-300))
    return {"r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - k) if n > k else float("nan"), "aic": ll + 2 * k, "bic": ll + k * math.log(n)}


def nested_test(n: int, rss0: float, k0: int, rss1: float, k1: int) -> dict:
    """Likelihood-ratio chi-squared with its upper tail, and F, of a model within another."""
    lr = max(n * math.log(max(rss0, 1e-300) / max(rss1, 1e-300)), 0.0)
    f = ((rss0 - rss1) / (k1 - k0)) / (rss1 / (n - k1)) if n > k1 and rss1 > 0 else float("nan")
    return {"chi2": lr, "p": chi2_sf(lr, k1 - k0), "f": f}


def polynomial_search(df: DataFrame, x: str, y: str, max_degree: int) -> list[dict]:
    """Fits of degree 0 to max_degree with their scores, all from the power sums of one aggregation.

    x is scaled to [-1, 1] for the sums; coefficients are given in x.
    """
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count(F.lit(1)).alias("n")).first()
    mid, half = (r.a + r.b) / 2, (r.b - r.a) / 2 or 1.0
    u = (F.col(x) - mid) / half
    cols = [f"_u{k}" for k in range(1, max_degree + 1)]
    n, a, b, yy = gram(df.select(F.col(y).alias("_y"), *[F.pow(u, F.lit(float(k))).alias(c) for k, c in enumerate(cols, 1)]), cols, "_y")
    out = []
    for d in range(min(max_degree, n - 1) + 1):
        w = np.linalg.lstsq(a[: d + 1, : d + 1], b[: d + 1], rcond=None)[0]
        rss = max(yy - w @ b[: d + 1], 0.0)
        scaled = np.polynomial.Polynomial(w)(np.polynomial.Polynomial([-mid / half, 1 / half]))
        out.append({"degree": d, "coefficients": scaled.coef, "rss": rss, **fit_scores(n, rss, yy - b[0] ** 2 / n, d + 1)})
    return out


def nonlinear_least_squares(model, x: np.ndarray, y: np.ndarray, p0, most: int = 200, tol: float = 1e-10) -> dict:
    """Levenberg-Marquardt on model(x, p), with numerical derivatives."""
    p, lam = np.asarray(p0, float), 1e-3
    cost = lambda q: float(((y - model(x, q)) ** 2).sum())
    now = cost(p)
    for k in range(most):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(model(x, p + d) - model(x, p - d)) / (2 * d[i]) for i, d in enumerate(np.diag(h))], axis=1)
        g, a = j.T @ (y - model(x, p)), j.T @ j
        step = np.linalg.lstsq(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
        new = cost(p + step)
        if new < now:
            done = now - new < tol * max(now, 1e-30)
            p, now, lam = p + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return {"p": p, "rss": now, "iterations": k + 1}


def svd(a: np.ndarray, rank: int | None = None) -> dict:
    """Thin decomposition, cut to the leading rank, with the shares of the squared singular values."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    share = s**2 / max((s**2).sum(), 1e-300)
    r = rank or len(s)
    return {"u": u[:, :r], "s": s[:r], "vt": vt[:r], "ratio": share[:r], "rank": int((s > (s[0] if len(s) else 0) * max(a.shape) * 2.2e-16).sum())}


def flag(score: Column, warning: float, critical: float) -> Column:
    """normal, warning or critical; null for no score."""
    return F.when(score >= critical, "critical").when(score >= warning, "warning").when(score.isNotNull(), "normal")


def evaluate(df: DataFrame, policy: dict, score: str = "score", n: str | None = None, quality: str | None = None) -> DataFrame:
    """df with flag, percentile and valid under a policy (warning, critical, mean, sd, window_n, min_quality).

    A window shorter than window_n, or a quality that is missing or under min_quality, is not valid and has no flag.
    """
    valid = F.col(score).isNotNull()
    if policy.get("window_n") is not None and n:
        valid = valid & F.coalesce(F.col(n) >= policy["window_n"], F.lit(False))
    if policy.get("min_quality") is not None and quality:
        valid = valid & F.coalesce(F.col(quality) >= policy["min_quality"], F.lit(False))
    rank = F.lit(None).cast("double")
    if policy.get("sd"):
        rank = 100 * normal_cdf((F.col(score) - policy["mean"]) / policy["sd"])
    return df.withColumns({"valid": valid, "flag": F.when(valid, flag(F.col(score), policy["warning"], policy["critical"])), "percentile": F.when(valid, rank)})


def policy_from_residuals(df: DataFrame, residual: str, warning_sd: float = 2.0, critical_sd: float = 3.0) -> dict:
    """Cuts at the mean of the absolute residuals plus so many of their sample deviations."""
    r = df.agg(F.avg(F.abs(residual)).alias("m"), F.stddev_samp(F.abs(residual)).alias("s")).first()
    return {"mean": r.m, "sd": r.s, "warning": r.m + warning_sd * r.s, "critical": r.m + critical_sd * r.s}


def relative_discretizer(df: DataFrame, group: str, x: str, bins: int, most: int = 100) -> list[float]:
    """Cuts between the sorted centres of one-dimensional k-means on values scaled to [0, 1] by group, from a histogram of 1000 cells."""
    from tidewave.operators.classification import grouped_range_scale

    cell = F.floor(F.least(F.col("scaled") * 1000, F.lit(999.0)))
    h = grouped_range_scale(df, group, x).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("scaled").alias("v")).orderBy("c").collect()
    v, n = np.array([r.v for r in h]), np.array([r.n for r in h], float)
    centres = np.quantile(np.repeat(v, np.maximum(n / n.sum() * 1000, 1).astype(int)), (np.arange(bins) + 0.5) / bins)
    for _ in range(most):
        at = np.abs(v[:, None] - centres[None]).argmin(1)
        new = np.array([np.average(v[at == k], weights=n[at == k]) if (at == k).any() else centres[k] for k in range(bins)])
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    centres = np.sort(centres)
    return ((centres[1:] + centres[:-1]) / 2).tolist()


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return [F.exp(s - top) / total for s in scores]


def one_vs_rest(df: DataFrame, columns: list[str], label: str, **kw) -> dict:
    """Binary logistic fits of each class against the others: {class: coefficients}."""
    from tidewave.operators.classification import logistic

    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return {c: logistic(df.withColumn("_c", (F.col(label) == c).cast("double")), columns, "_c", **kw) for c in classes}


def one_vs_rest_predict(df: DataFrame, fit: dict, columns: list[str], name: str = "predicted") -> DataFrame:
    """The class of the greatest score, the first on ties."""
    score = lambda w: sum((F.col(c) * float(v) for c, v in zip(columns, w[1:], strict=True)), F.lit(float(w[0])))
    best = F.array_max(F.array(*[F.struct(score(w).alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, w) in enumerate(fit.items())]))
    return df.withColumn(name, best["c"])


def growth_data(groups: int, times: int, beta=(1.0, 0.5), sd_intercept: float = 1.0, sd_slope: float = 0.2, sd_error: float = 0.5, seed: int = 0) -> pd.DataFrame:
    """grp, t and y of straight growth with normal intercepts and slopes by group."""
    rng = np.random.default_rng(seed)
    u, v, t = rng.normal(0, sd_intercept, groups), rng.normal(0, sd_slope, groups), np.arange(times, dtype=float)
    y = beta[0] + u[:, None] + (beta[1] + v[:, None]) * t + rng.normal(0, sd_error, (groups, times))
    return pd.DataFrame({"grp": np.repeat(np.arange(groups), times), "t": np.tile(t, groups), "y": y.ravel()})
