"""Queries of the mixed models, every customer a group, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import mixed
from tidewave.registry import query, tidy

# restricted likelihood of a random intercept, by golden section on the log of the relative variance
_FIT = """WITH RECURSIVE d AS (SELECT o_custkey AS grp, dayofyear(o_orderdate) / 365.0 AS t, o_totalprice / 1e5 + c_acctbal / 1e4 AS y FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT grp, count(*)::DOUBLE AS n, sum(t) AS t, sum(y) AS y, sum(t * t) AS tt, sum(t * y) AS ty, sum(y * y) AS yy FROM d GROUP BY grp),
l AS (SELECT list({'n': n, 't': t, 'y': y}) AS g, sum(n) AS n, sum(t) AS t, sum(y) AS y, sum(tt) AS tt, sum(ty) AS ty, sum(yy) AS yy FROM g),
tries(k, lo, hi) AS (SELECT 0, -14.0::DOUBLE, 14.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN f1 <= f2 THEN lo ELSE x1 END, CASE WHEN f1 <= f2 THEN x2 ELSE hi END FROM (SELECT k, lo, hi, x1, x2, {DEV1} AS f1, {DEV2} AS f2 FROM
        (SELECT k, lo, hi, x1, x2, l.*, {SUMS1}, {SUMS2} FROM (SELECT *, hi - (hi - lo) * 0.6180339887498949 AS x1, lo + (hi - lo) * 0.6180339887498949 AS x2 FROM tries WHERE k < 50), l))),
best AS (SELECT exp((lo + hi) / 2) AS v FROM tries ORDER BY k DESC LIMIT 1),
s AS (SELECT v, l.*, {SUMS} FROM best, l),
a AS (SELECT v, n, n - d11 AS a11, t - d12 AS a12, tt - d22 AS a22, y - e1 AS b1, ty - e2 AS b2, yy - c AS c FROM s),
b AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS beta0, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS beta1 FROM a),
fit AS (SELECT *, (c - b1 * beta0 - b2 * beta1) / (n - 2) AS sigma2 FROM b)"""


def _sums(v: str, k: str = "") -> str:
    part = lambda a, b: f"list_sum(list_transform(g, lambda r: {a} * {b} * {v} / (1 + {v} * r.n)))"
    cells = {"d11": ("r.n", "r.n"), "d12": ("r.n", "r.t"), "d22": ("r.t", "r.t"), "e1": ("r.n", "r.y"), "e2": ("r.t", "r.y"), "c": ("r.y", "r.y")}
    return ", ".join(f"{part(a, b)} AS {n}{k}" for n, (a, b) in cells.items()) + f", list_sum(list_transform(g, lambda r: ln(1 + {v} * r.n))) AS ld{k}"


def _deviance(k: str) -> str:
    a = f"((n - d11{k}) * (tt - d22{k}) - (t - d12{k}) * (t - d12{k}))"
    b1, b2 = f"(y - e1{k})", f"(ty - e2{k})"
    rss = f"(yy - c{k} - ({b1} * ((tt - d22{k}) * {b1} - (t - d12{k}) * {b2}) + {b2} * ((n - d11{k}) * {b2} - (t - d12{k}) * {b1})) / {a})"
    return f"ld{k} + (n - 2) * ln({rss} / (n - 2)) + ln({a})"


for _name, _text in {"DEV1": _deviance("_1"), "DEV2": _deviance("_2"), "SUMS1": _sums("exp(x1)", "_1"), "SUMS2": _sums("exp(x2)", "_2"), "SUMS": _sums("v")}.items():
    _FIT = _FIT.replace("{" + _name + "}", _text)


def _orders(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("o_custkey").alias("grp"), (F.dayofyear("o_orderdate") / 365.0).alias("t"), (F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 1e4).alias("y"))


@query(f"{_FIT} SELECT round(beta0, 4) AS intercept, round(beta1, 4) AS slope, round(sigma2, 4) AS sigma2, round(v * sigma2, 4) AS between_groups, n::BIGINT AS n FROM fit")
def mixed_model(t):
    fit = mixed.lmer(_orders(t), "grp", ["t"], [], "y")
    row = (float(fit["beta"][0]), float(fit["beta"][1]), float(fit["sigma2"]), float(fit["covariance"][0, 0]), fit["n"])
    return tidy(t("orders").sparkSession.createDataFrame([row], "intercept double, slope double, sigma2 double, between_groups double, n long"), 4)


@query(f"{_FIT} SELECT grp, round(v * (g.y - g.n * beta0 - g.t * beta1) / (1 + v * g.n), 3) AS effect FROM g, fit")
def mixed_effects(t):
    fit = mixed.lmer(_orders(t), "grp", ["t"], [], "y")
    return tidy(fit["ranef"].select("grp", F.col("effects")[0].alias("effect")), 3)


@query(f"{_FIT} SELECT o_orderkey, round(fixed, 2) AS population, round(fixed + v * (g.y - g.n * beta0 - g.t * beta1) / (1 + v * g.n), 2) AS own FROM (SELECT o_orderkey, o_custkey, v, beta0, beta1, beta0 + beta1 * dayofyear(o_orderdate) / 365.0 AS fixed FROM orders, fit) JOIN g ON grp = o_custkey")
def mixed_predictions(t):
    d = _orders(t)
    fit = mixed.lmer(d, "grp", ["t"], [], "y")
    d = mixed.lmer_predict(mixed.lmer_predict(d, fit, "grp", ["t"], [], "population", conditional=False), fit, "grp", ["t"], [], "own")
    return tidy(d.select("o_orderkey", "population", "own"), 2)
