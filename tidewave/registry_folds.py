"""Queries of cross-validation, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import folds
from tidewave.registry import query, tidy

_ROWS = """r AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice / 1e4 AS y, CASE WHEN l_linenumber > 5 THEN 'test' ELSE 'train' END AS part, CASE WHEN l_linenumber <= 5 THEN l_linenumber - 1 END AS fold FROM lineitem),
k AS (SELECT 'full' AS split, NULL::BIGINT AS f UNION ALL SELECT 'train', NULL UNION ALL SELECT 'test', NULL UNION ALL SELECT 'fold', unnest(range(0, 5))),
fit AS (SELECT split, f, r.* FROM k JOIN r ON split = 'full' OR (part = 'train' AND (split <> 'fold' OR fold <> f))),
val AS (SELECT split, f, r.* FROM k JOIN r ON split = 'full' OR (split = 'train' AND part = 'train') OR (split = 'test' AND part = 'test') OR (split = 'fold' AND part = 'train' AND fold = f))"""


def _split(t):
    k = F.col("l_linenumber")
    part, fold = F.when(k > 5, "test").otherwise("train"), F.when(k <= 5, k - 1).cast("int")
    return t("lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), (F.col("l_extendedprice") / 1e4).alias("y"), part.alias("part"), fold.alias("fold"))


@query(f"""WITH {_ROWS}, m AS (SELECT split, f, count(*) AS n_fit, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM fit GROUP BY 1, 2),
w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT split, f AS fold, any_value(n_fit) AS n_fit, count(*) AS n, round(any_value(wa), 6) AS slope_a, round(any_value(wb), 6) AS slope_b, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) + 0.0 AS bias, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT val.*, n_fit, wa, wb, y - (my + wa * (a - ma) + wb * (b - mb)) AS e FROM val JOIN w ON w.split = val.split AND w.f IS NOT DISTINCT FROM val.f) GROUP BY 1, 2""")
def linear_folds(t):
    d = folds.linear_folds(_split(t), ["a", "b"], "y")
    return tidy(d.select("split", "fold", "n_fit", "n", F.col("coefficients")[1].alias("slope_a"), F.col("coefficients")[2].alias("slope_b"), "rmse", "bias", "r2"))


@query(f"""WITH {_ROWS}, m AS (SELECT split, f, count(*) AS n_fit, avg(a) AS ma, avg(y) AS my, covar_pop(a, y) / (var_pop(a) * (1 + 500.0 / count(*))) AS wa FROM fit GROUP BY 1, 2)
SELECT split, f AS fold, any_value(n_fit) AS n_fit, count(*) AS n, round(any_value(wa), 6) AS slope, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT val.*, n_fit, wa, y - (my + wa * (a - ma)) AS e FROM val JOIN m ON m.split = val.split AND m.f IS NOT DISTINCT FROM val.f) GROUP BY 1, 2""")
def ridge_folds(t):
    d = folds.linear_folds(_split(t), ["a"], "y", alpha=500.0)
    return tidy(d.select("split", "fold", "n_fit", "n", F.col("coefficients")[1].alias("slope"), "rmse", "r2"))


_STEPS = 30


@query(f"""WITH RECURSIVE {_ROWS}, s AS (SELECT split, f, avg(a) AS m, stddev_pop(a) AS sd, count(*) AS n_fit, list({{'a': a, 'y': (y > 3.8)::INT}}) AS rows FROM fit WHERE split <> 'test' GROUP BY 1, 2),
z AS (SELECT split, f, n_fit, m, sd, list_transform(rows, lambda r: {{'x': (r.a - m) / sd, 'y': r.y}}) AS rows FROM s),
g(split, f, step, w0, w1) AS (SELECT split, f, 0, 0::DOUBLE, 0::DOUBLE FROM z UNION ALL SELECT g.split, g.f, step + 1, w0 - 0.5 * list_avg(list_transform(rows, lambda r: 1 / (1 + exp(-(w0 + w1 * r.x))) - r.y)), w1 - 0.5 * list_avg(list_transform(rows, lambda r: r.x * (1 / (1 + exp(-(w0 + w1 * r.x))) - r.y))) FROM g JOIN z ON z.split = g.split AND z.f IS NOT DISTINCT FROM g.f WHERE step < {_STEPS}),
w AS (SELECT g.split, g.f, n_fit, w0, w1, m, sd FROM g JOIN z ON z.split = g.split AND z.f IS NOT DISTINCT FROM g.f WHERE step = {_STEPS}), v AS (SELECT * FROM w UNION ALL SELECT 'test', f, n_fit, w0, w1, m, sd FROM w WHERE split = 'train'),
p AS (SELECT val.split, val.f, n_fit, w1 / sd AS slope, (y > 3.8)::INT AS y, 1 / (1 + exp(-(w0 + w1 * (a - m) / sd))) AS p FROM val JOIN v ON v.split = val.split AND v.f IS NOT DISTINCT FROM val.f)
SELECT split, f AS fold, any_value(n_fit) AS n_fit, count(*) AS n, round(any_value(slope), 6) AS slope, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p GROUP BY 1, 2""")
def logistic_folds(t):
    d = _split(t).withColumn("y", (F.col("y") > 3.8).cast("int"))
    d = folds.logistic_folds(d, ["a"], "y", rate=0.5, most=_STEPS, tol=0.0)
    return tidy(d.select("split", "fold", "n_fit", "n", F.col("coefficients")[1].alias("slope"), "accuracy", "log_loss"))
