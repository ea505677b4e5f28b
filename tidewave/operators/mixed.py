"""Gaussian linear mixed models with one grouping factor of any number of groups.

A group takes part by the cross products of its rows alone. These stay in Spark, a row a group; one aggregation over them
gives the profiled deviance at many covariances at once, so that a step of the search is a job or two, whatever the
number of groups, and only sums of the model's size reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (log scale of the first random effect, of the others) that the search starts from.
STARTS = [(0.0, -1.0), (1.0, 0.0), (-1.0, -2.0), (0.5, -0.5), (-0.5, -1.5)]
#: Scales beyond these exponents count as no, or as infinitely large, random effects.
LEAST, GREATEST = -14.0, 14.0
DIAGONAL, UNSTRUCTURED = "diagonal", "unstructured"


@dataclass
class Layout:
    """Places of the columns 1, x, z and y in the vector whose products are summed."""

    x: list[str]
    z: list[str]
    y: str

    @property
    def names(self) -> list[str]:
        return ["1", *dict.fromkeys([*self.x, *self.z]), self.y]

    @property
    def fixed(self) -> list[int]:
        return [self.names.index(c) for c in ["1", *self.x]]

    @property
    def random(self) -> list[int]:
        return [self.names.index(c) for c in ["1", *self.z]]

    def blocks(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """xx, xz, zz, xy, zy, yy and n of a batch of groups, stacked."""
        m = len(self.names)
        flat = np.asarray(batch.column("products").flatten(), float).reshape(batch.num_rows, -1)
        s = np.zeros((batch.num_rows, m, m))
        i, j = np.triu_indices(m)
        s[:, i, j] = s[:, j, i] = flat
        f, r, y = self.fixed, self.random, m - 1
        return s[:, f][:, :, f], s[:, f][:, :, r], s[:, r][:, :, r], s[:, f, y], s[:, r, y], s[:, y, y], s[:, 0, 0]


def group_products(df: DataFrame, group: str, x: list[str], z: list[str], y: str) -> DataFrame:
    """(group, products): the sums over each group of the products of 1, x, z and y with one another. Rows with a null stay out."""
    layout = Layout(x, z, y)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in layout.names[1:]]]
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.dropna(subset=[*layout.names[1:], group]).groupBy(group).agg(F.array(*sums).alias("products"))


def factor(theta: np.ndarray, q: int, structure: str) -> np.ndarray:
    """The lower factor of the relative covariance: logs of scales on the diagonal, what lies below it as it is, by columns.

    Of a diagonal covariance theta has the logs of the variances.
    """
    l = np.zeros((q, q))
    if structure == DIAGONAL:
        np.fill_diagonal(l, np.exp(np.clip(theta, LEAST, GREATEST) / 2))
        return l
    j, i = np.triu_indices(q)
    l[i, j] = theta
    np.fill_diagonal(l, np.exp(np.clip(np.diag(l), LEAST / 2, GREATEST / 2)))
    return l


def _start(first: float, rest: float, q: int, structure: str) -> np.ndarray:
    scales = np.array([first] + [rest] * (q - 1))
    if structure == DIAGONAL:
        return scales
    j, i = np.triu_indices(q)
    return np.where(i == j, scales[i], 0.0)


def _sums(products: DataFrame, layout: Layout, factors: list[np.ndarray]) -> list[tuple]:
    """(a, b, c, logdet, n, groups) for each factor: x'V^-1x, x'V^-1y, y'V^-1y and the log of V's determinant, over all groups."""
    p = len(layout.fixed)

    def run(batches):
        total = np.zeros((len(factors), p * p + p + 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            xx, xz, zz, xy, zy, yy, n = layout.blocks(batch)
            for k, l in enumerate(factors):
                m = np.eye(len(l)) + l.T @ zz @ l
                right = np.linalg.solve(m, np.concatenate([l.T @ xz.transpose(0, 2, 1), (zy @ l)[:, :, None]], axis=2))
                left = np.concatenate([xz @ l, (zy @ l)[:, None, :]], axis=1)
                less = (left @ right).sum(axis=0)
                total[k, : p * p] += (xx.sum(axis=0) - less[:p, :p]).ravel()
                total[k, p * p : p * p + p] += xy.sum(axis=0) - less[:p, p]
                total[k, -4:] += [yy.sum() - less[p, p], np.linalg.slogdet(m)[1].sum(), n.sum(), len(n)]
        k, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], names=["k", "i", "v"])

    out = np.zeros((len(factors), p * p + p + 4))
    got = products.select("products").mapInArrow(run, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    out[got.k.to_numpy(), got.i.to_numpy()] = got.v
    return [(r[: p * p].reshape(p, p), r[p * p : p * p + p], r[-4], r[-3], int(r[-2]), int(r[-1])) for r in out]


def _solved(s: tuple, reml: bool) -> tuple[float, np.ndarray, float]:
    """(profiled deviance, beta, sigma2) of the sums."""
    a, b, c, logdet, n, _ = s
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    free = n - len(b) if reml else n
    rss = max(c - b @ beta, 1e-300)
    return logdet + free * math.log(rss / free) + (np.linalg.slogdet(a)[1] if reml else 0.0), beta, rss / free


def minimise(evaluate, starts: list[np.ndarray], most: int, tol: float) -> tuple[np.ndarray, float, int, bool]:
    """(point, value, steps, whether it converged) of the least value that Newton's method finds from several starts.

    evaluate takes all points of a step, of all starts, at once: first those around each, for its derivatives, then some
    along each step.
    """
    h, k = 1e-3, len(starts[0])
    e = np.eye(k) * h
    pairs = [(i, j) for i in range(k) for j in range(i)]
    around = [*e, *-e, *[e[i] + e[j] for i, j in pairs], *[-e[i] - e[j] for i, j in pairs]]
    x, f = np.array(starts, float), np.array(evaluate(starts))
    live = np.ones(len(x), bool)
    for step in range(most):
        at = np.flatnonzero(live)
        if not len(at):
            return x[f.argmin()], float(f.min()), step, True
        v = np.array(evaluate([x[s] + d for s in at for d in around])).reshape(len(at), -1)
        tries = []
        for s, w in zip(at, v, strict=True):
            up, down = w[:k], w[k : 2 * k]
            g, hess = (up - down) / (2 * h), np.diag((up + down - 2 * f[s]) / h**2)
            for n, (i, j) in enumerate(pairs):
                both = w[2 * k + n] + w[2 * k + len(pairs) + n]
                hess[i, j] = hess[j, i] = (both - up[i] - down[i] - up[j] - down[j] + 2 * f[s]) / (2 * h**2)
            lam, vec = np.linalg.eigh(hess)
            d = -vec @ ((vec.T @ g) / np.maximum(np.abs(lam), 1e-3 * max(1.0, np.abs(lam).max())))
            d *= min(1.0, 4 / max(np.abs(d).max(), 1e-300))
            tries.append([x[s] + t * d for t in (1.0, 0.5, 0.2, 0.05, 0.01)])
        v = np.array(evaluate([p for ps in tries for p in ps])).reshape(len(at), -1)
        for s, ps, w in zip(at, tries, v, strict=True):
            best = int(w.argmin())
            live[s] = f[s] - w[best] > tol * (1 + abs(f[s]))
            if not live[s] and w[0] <= f[s] + tol * (1 + abs(f[s])):
                best = 0  # where values no longer tell points apart, derivatives still do
            if w[best] < f[s] or best == 0 and not live[s]:
                x[s], f[s] = ps[best], w[best]
    return x[f.argmin()], float(f.min()), most, False


def lmer(df: DataFrame, group: str, x: list[str], z: list[str], y: str, reml: bool = True, structure: str = UNSTRUCTURED, starts: int = 4, most: int = 60, tol: float = 1e-12) -> dict:
    """A mixed model with fixed intercept and x, and random intercept and z by group, by (restricted) maximum likelihood.

    structure: whether random effects may be correlated. Gives beta, sigma2, covariance of the random effects, deviance,
    loglik, theta, n, n_groups, steps, converged, and ranef, a frame (group, effects) with the predicted effects of each
    group. The search goes on from several starts at once, from one if there is one random effect; no random effects at
    all are tried too. Rows with a null in a column of the model are left out; without rows or groups: an error. The
    products of the groups are kept in Spark's cache meanwhile.
    """
    layout, q = Layout(x, z, y), len(z) + 1
    products = group_products(df, group, x, z, y).persist()
    try:
        evaluate = lambda thetas: [_solved(s, reml)[0] for s in _sums(products, layout, [factor(t, q, structure) for t in thetas])]
        none = _sums(products, layout, [np.zeros((q, q))])[0]
        if none[4] <= len(layout.fixed):
            raise ValueError(f"{none[4]} rows don't fit {len(layout.fixed)} coefficients")
        theta, value, steps, converged = minimise(evaluate, [_start(a, b, q, structure) for a, b in STARTS[: starts if q > 1 else 1]], most, tol)
        l = factor(theta, q, structure) if value < _solved(none, reml)[0] else np.zeros((q, q))
        sums = _sums(products, layout, [l])[0]
        deviance, beta, sigma2 = _solved(sums, reml)
    finally:
        products.unpersist()
    free = sums[4] - len(beta) if reml else sums[4]
    fit = {"beta": beta, "sigma2": sigma2, "covariance": sigma2 * l @ l.T, "theta": theta, "deviance": deviance, "loglik": -0.5 * (free * math.log(2 * math.pi) + deviance + free)}
    return fit | {"n": sums[4], "n_groups": sums[5], "steps": steps, "converged": converged, "ranef": _effects(group_products(df, group, x, z, y), group, layout, beta, l)}


def _effects(products: DataFrame, group: str, layout: Layout, beta: np.ndarray, l: np.ndarray) -> DataFrame:
    schema = T.StructType([products.schema[group], T.StructField("effects", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            _, xz, zz, _, zy, _, _ = layout.blocks(batch)
            u = np.linalg.solve(np.eye(len(l)) + l.T @ zz @ l, ((zy - beta @ xz) @ l)[:, :, None])[:, :, 0] @ l.T
            effects = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * len(l)), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(group), effects], names=[group, "effects"])

    return products.mapInArrow(run, schema)


def lmer_predict(df: DataFrame, fit: dict, group: str, x: list[str], z: list[str], name: str = "predicted", conditional: bool = True) -> DataFrame:
    """df with the fixed effects plus, if conditional, the group's random ones; groups that weren't fitted have none."""
    fixed = sum((F.col(c) * float(b) for c, b in zip(x, fit["beta"][1:], strict=True)), F.lit(float(fit["beta"][0])))
    if not conditional:
        return df.withColumn(name, fixed)
    u = fit["ranef"].select(F.col(group).alias("_g"), F.col("effects").alias("_u"))
    own = sum((F.col(c) * F.get("_u", F.lit(i)) for i, c in enumerate(z, 1)), F.get("_u", F.lit(0)))
    return df.join(u, df[group] == u["_g"], "left").withColumn(name, fixed + F.coalesce(own, F.lit(0.0))).drop("_g", "_u")
