"""Cross-validation as one plan: models of all folds from sums by fold, each fit set being the total less one fold.

Rows carry part ('train' or 'test') and fold (a number in train, null in test), as models.train_test_split gives them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.classification import sigmoid


@dataclass
class Sums:
    """Products of (1, x..., y) over some rows: a[0, 0] is their number."""

    a: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.a - other.a)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.a + other.a)

    @property
    def n(self) -> int:
        return int(round(self.a[0, 0]))


def fold_sums(df: DataFrame, columns: list[str], y: str) -> dict[tuple[str, int | None], Sums]:
    """The sums of each part and fold, in one aggregation; rows with a null in a column or without a part stay out."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*columns, y]]]
    m = len(cols)
    g = df.dropna(subset=[*columns, y, "part"]).groupBy("part", "fold").agg(F.array(*[F.sum(cols[i] * cols[j]) for i in range(m) for j in range(i, m)]).alias("s"))
    out = {}
    for r in g.collect():
        a = np.zeros((m, m))
        a[np.triu_indices(m)] = r.s
        out[r.part, r.fold] = Sums(a + np.triu(a, 1).T)
    return out


def splits(sums: dict[tuple[str, int | None], Sums]) -> list[tuple[str, int | None, Sums, Sums]]:
    """(split, fold, sums it is fitted on, sums it is scored on): full, train, test and one for each fold."""
    zero = Sums(np.zeros_like(next(iter(sums.values())).a))
    add = lambda part: sum((s for (p, _), s in sums.items() if p == part), zero)
    train, test = add("train"), add("test")
    out = [("full", None, train + test, train + test), ("train", None, train, train)] + ([("test", None, train, test)] if test.n else [])
    folds = sorted(f for p, f in sums if p == "train" and f is not None)
    return out + [("fold", f, train - sums["train", f], sums["train", f]) for f in folds if len(folds) > 1]


def _solved(s: Sums, alpha: float, scale: bool) -> np.ndarray:
    """Intercept and coefficients, of the columns as they are; alpha holds for scaled columns if scale."""
    n, mean = s.a[0, 0], s.a[0] / s.a[0, 0]
    cov = s.a / n - np.outer(mean, mean)
    xx, xy = cov[1:-1, 1:-1], cov[1:-1, -1]
    sd = np.sqrt(np.maximum(np.diag(xx), 0.0))
    sd = np.where(scale & (sd > 1e-12), sd, 1.0)
    w = np.linalg.lstsq(xx / np.outer(sd, sd) + alpha / n * np.eye(len(sd)), xy / sd, rcond=None)[0] / sd
    return np.r_[mean[-1] - w @ mean[1:-1], w]


def _scores(s: Sums, w: np.ndarray) -> dict[str, float | None]:
    v = np.r_[-w, 1.0]
    n, rss, bias = float(s.a[0, 0]), max(float(v @ s.a @ v), 0.0), float(v @ s.a[0])
    tss = float(s.a[-1, -1] - s.a[0, -1] ** 2 / n)
    return {"mse": rss / n, "rmse": float(np.sqrt(rss / n)), "bias": bias / n, "r2": 1 - rss / tss if tss > 0 else None}


def linear_folds(df: DataFrame, columns: list[str], y: str, alpha: float = 0.0, scale: bool = True) -> DataFrame:
    """(split, fold, n_fit, n, coefficients, mse, rmse, bias, r2) of least squares (ridge with alpha) of every split.

    One pass over the rows: means and deviations that columns are scaled by, normal equations and scores of each fit set come
    from the sums by fold. bias is the mean of y less what is predicted; r2 null for a constant y. A fold that is all of train,
    and a fit or validation set without rows, have no row.
    """
    rows = []
    for name, fold, fit, val in splits(s) if (s := fold_sums(df, columns, y)) else []:
        if fit.n and val.n:
            w = _solved(fit, alpha, scale)
            rows.append((name, fold, fit.n, val.n, w.tolist(), *_scores(val, w).values()))
    return df.sparkSession.createDataFrame(rows, "split string, fold int, n_fit long, n long, coefficients array<double>, mse double, rmse double, bias double, r2 double")


def _members(folds: list[int]) -> list[tuple[str, int | None, Column, Column]]:
    """(split, fold, whether a row is fitted on, whether it is scored)."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    out = [("full", None, train | test, train | test), ("train", None, train, train), ("test", None, train, test)]
    own = lambda f: F.coalesce(F.col("fold") == f, F.lit(False))
    return out + [("fold", f, train & ~own(f), train & own(f)) for f in folds if len(folds) > 1]


def logistic_folds(df: DataFrame, columns: list[str], y: str, rate: float = 0.1, most: int = 1000, tol: float = 1e-6, l2: float = 0.0) -> DataFrame:
    """(split, fold, n_fit, n, coefficients, accuracy, log_loss) of logistic models of every split, y being 0 or 1.

    Gradient descent from zero on columns scaled by each fit set; a step of all models is one aggregation over the rows,
    which are kept in Spark's cache meanwhile. A model that has reached the tolerance stays as it is. coefficients are those
    of the columns as they are.
    """
    sums = fold_sums(df, columns, y)
    if not sums:
        return df.sparkSession.createDataFrame([], "split string, fold int, n_fit long, n long, coefficients array<double>, accuracy double, log_loss double")
    folds = sorted(f for p, f in sums if p == "train" and f is not None)
    sizes = {(name, f): (a, b) for name, f, a, b in splits(sums)}
    models = [m for m in _members(folds) if (m[0], m[1]) in sizes and sizes[m[0], m[1]][0].n and sizes[m[0], m[1]][1].n]
    fitted = [k for k, m in enumerate(models) if m[0] != "test"]  # the test set is scored by train's model
    rows = df.dropna(subset=[*columns, y, "part"]).select("part", "fold", *[F.col(c).cast("double") for c in columns], F.col(y).cast("double").alias("_y")).persist()
    w = np.zeros((len(models), len(columns) + 1))
    mean, sd = np.zeros((len(models), len(columns))), np.ones((len(models), len(columns)))
    for k, m in enumerate(models):
        a = sizes[m[0], m[1]][0].a
        mean[k] = a[0, 1:-1] / a[0, 0]
        s = np.sqrt(np.maximum(np.diag(a)[1:-1] / a[0, 0] - mean[k] ** 2, 0))
        sd[k] = np.where(s > 1e-12, s, 1.0)
    raw = lambda k: np.r_[w[k, 0] - (w[k, 1:] * mean[k] / sd[k]).sum(), w[k, 1:] / sd[k]]
    chance = lambda k: sigmoid(sum((F.col(c) * float(v) for c, v in zip(columns, raw(k)[1:], strict=True)), F.lit(float(raw(k)[0]))))
    try:
        live = list(fitted)
        for _ in range(most):
            aggs = []
            for k in live:
                e = F.when(models[k][2], chance(k) - F.col("_y"))
                aggs += [F.sum(e), *[F.sum(e * F.col(c)) for c in columns]]
            got = np.array(rows.agg(*aggs).first(), float).reshape(len(live), -1)
            going = []
            for k, g in zip(live, got, strict=True):
                n = sizes[models[k][0], models[k][1]][0].n
                g = np.r_[g[0], (g[1:] - g[0] * mean[k]) / sd[k]] / n
                g[1:] += l2 * w[k, 1:]
                w[k] -= rate * g
                if np.abs(rate * g).max() >= tol:
                    going.append(k)
            live = going
            if not live:
                break
        for k, m in enumerate(models):
            if m[0] == "test":
                w[k] = w[next(j for j, o in enumerate(models) if o[0] == "train")]
        aggs = []
        for k, m in enumerate(models):
            p = F.least(F.greatest(chance(k), F.lit(1e-15)), F.lit(1 - 1e-15))
            loss = -(F.col("_y") * F.ln(p) + (1 - F.col("_y")) * F.ln(1 - p))
            aggs += [F.avg(F.when(m[3], ((p >= 0.5).cast("double") == F.col("_y")).cast("double"))), F.avg(F.when(m[3], loss))]
        scored = np.array(rows.agg(*aggs).first(), float).reshape(len(models), 2)
    finally:
        rows.unpersist()
    out = [(m[0], m[1], sizes[m[0], m[1]][0].n, sizes[m[0], m[1]][1].n, raw(k).tolist(), float(scored[k, 0]), float(scored[k, 1])) for k, m in enumerate(models)]
    return df.sparkSession.createDataFrame(out, "split string, fold int, n_fit long, n long, coefficients array<double>, accuracy double, log_loss double")
