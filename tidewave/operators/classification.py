"""Scalers, splits, classifiers and their measures on feature frames.

Models are fitted from sums that partial aggregation gathers, so what reaches the driver has the size of the model; only
neighbour search compares rows, in blocks of stated queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import ratio
from tidewave.operators.statistics import distances
from tidewave.plans.prefix import running_sums


def standard_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column; a constant's scale is 1."""
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] if r[f"s_{c}"] and r[f"s_{c}"] > 0 else 1.0) for c in columns}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]], inverse: bool = False) -> DataFrame:
    return df.withColumns({c: F.col(c) * s + m if inverse else (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def min_max(df: DataFrame, columns: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Columns scaled to [lo, hi] by the least and greatest value of all; a constant becomes lo."""
    r = df.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    cell = lambda c: (F.col(c) - r[f"a_{c}"]) / (r[f"b_{c}"] - r[f"a_{c}"]) * (hi - lo) + lo if r[f"b_{c}"] != r[f"a_{c}"] else F.lit(float(lo))
    return df.withColumns({c: cell(c) for c in columns})


def grouped_range_scale(df: DataFrame, by: str, x: str, name: str = "scaled") -> DataFrame:
    """x scaled by the least and greatest value of its group to [0, 1]; 0.5 where they are the same."""
    r = df.groupBy(by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    return df.join(r, by).withColumn(name, F.when(F.col("_b") > F.col("_a"), (F.col(x) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.5)).drop("_a", "_b")


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(true_class, predicted_class, count) of the pairs that occur."""
    return df.groupBy(F.col(y).alias("true_class"), F.col(p).alias("predicted_class")).agg(F.count(F.lit(1)).alias("count"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each class, 0 for a zero denominator."""
    c = confusion(df, y, p)
    r = c.select(F.col("true_class").alias("label"), F.when(F.col("true_class") == F.col("predicted_class"), F.col("count")).otherwise(0).alias("tp"), F.col("count").alias("support"), F.lit(0).alias("predicted"))
    q = c.select(F.col("predicted_class").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("count").alias("predicted"))
    s = r.unionByName(q).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    pr, re = ratio(F.col("tp"), F.col("predicted"), 0.0), ratio(F.col("tp"), F.col("support"), 0.0)
    return s.select("label", pr.alias("precision"), re.alias("recall"), ratio(2 * pr * re, pr + re, 0.0).alias("f1"), "support")


def overall(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall of the classes that occur), macro precision, recall and f1."""
    acc = df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
    r = classification_report(df, y, p).agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return acc.join(F.broadcast(r))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr), scores descending, equal ones as one point, from (infinity, 0, 0).

    Scores are grouped first; the running sums go through as many rows as there are different scores, range by range.
    """
    g = _by_score(df, y, score).persist()
    total = g.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    c = running_sums(g.withColumn("low", -F.col("s")), "low", ["p", "n"]).join(F.broadcast(total))
    c = c.select(F.col("s").alias("threshold"), ratio(F.col("run_n"), F.col("tn"), 0.0).alias("fpr"), ratio(F.col("run_p"), F.col("tp"), 0.0).alias("tpr"))
    return c.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double").union(c)


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """(s, p, n): how many rows of class 1 and of others have each score. Its callers read it several times and keep it, a
    row for each different score, until the session's cache is cleared."""
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    return d.agg(F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(1.0)).alias("n"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row, auc: the trapezoidal area under the curve, from running counts of grouped scores; null without both classes."""
    g = running_sums(_by_score(df, y, score).persist(), "s", ["n"], before=True)
    return g.agg(F.try_divide(F.sum(F.col("p") * (F.col("run_n") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def gaussian_nb(df: DataFrame, columns: list[str], label: str, smoothing: float = 1e-9) -> DataFrame:
    """One row per class: label, prior, and mean and variance of each column, the variance with smoothing times the largest of all. One pass over df."""
    stats = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), *stats).collect()
    n, top = sum(r.n for r in rows), 0.0
    for c in columns:
        size, mean, var = (np.array([r[f"{k}_{c}"] for r in rows if r[f"n_{c}"]], float) for k in ("n", "mean", "var"))
        if len(size):
            top = max(top, float((size * (var + (mean - np.average(mean, weights=size)) ** 2)).sum() / size.sum()))
    spread = lambda v: None if v is None else v + smoothing * top
    kind = dict(df.dtypes)[label]
    schema = f"label {kind}, prior double, " + ", ".join([f"`mean_{c}` double" for c in columns] + [f"`var_{c}` double" for c in columns])
    return df.sparkSession.createDataFrame([(r.label, r.n / n, *[r[f"mean_{c}"] for c in columns], *[spread(r[f"var_{c}"]) for c in columns]) for r in rows], schema)


def nb_predict(df: DataFrame, model: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns keep and predicted: the class of the greatest log joint probability, the first label on ties.

    The model has a row for each class and is sent to all tasks as one expression.
    """
    import math

    classes = sorted(model.collect(), key=lambda r: r.label)
    part = lambda r, c: -0.5 * (math.log(2 * math.pi * r[f"var_{c}"]) + (F.col(c) - r[f"mean_{c}"]) * (F.col(c) - r[f"mean_{c}"]) / r[f"var_{c}"]) if r[f"var_{c}"] > 0 else F.lit(0.0)
    scored = F.array(*[F.struct(sum((part(r, c) for c in columns), F.lit(math.log(r.prior))).alias("s"), F.lit(-k).alias("k"), F.lit(r.label).alias("label")) for k, r in enumerate(classes)])
    return df.select(*keep, F.array_max(scored)["label"].alias("predicted"))


#: Training rows and queries that one task compares: with 64 components, 8 MB and 0.5 MB.
KNN_ROWS, KNN_QUERIES = 16_384, 1024


def knn_votes(train: DataFrame, queries: DataFrame, k: int, vec: str, label: str, train_id: str, query_id: str, metric: str = "euclidean", weighted: bool = False, others: bool = False) -> DataFrame:
    """(query_id, y, v): the votes of the k nearest training rows for each of their labels, 1 or the inverse distance each.

    Training rows and queries are dealt to blocks of bounded size; each block of queries meets each block of rows once, as
    many tasks as there are such meetings, keeps k of it, and then k of all. Equal distances go to the smaller training id.
    others: a training row of the query's own id doesn't count.
    """
    n_t, n_q = max(1, -(-train.count() // KNN_ROWS)), max(1, -(-queries.count() // KNN_QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = train.select(deal(train_id, n_t).alias("_b"), every(n_q).alias("_a"), F.col(train_id).alias("_t"), F.col(vec).alias("_v"), F.col(label).alias("_y"))
    q = queries.select(deal(query_id, n_q).alias("_a"), every(n_t).alias("_b"), F.col(query_id).alias("query_id"), F.col(vec).alias("_q"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("_t", kind="stable")
            x, y, ids = np.stack(right._v.to_list()).astype(float), right._y.to_numpy(), right._t.to_numpy()
            for q_id, v in zip(left.query_id, left._q, strict=True):
                d = np.abs(x - np.asarray(v, float))
                dist = {"euclidean": lambda d: np.sqrt((d * d).sum(1)), "manhattan": lambda d: d.sum(1), "chebyshev": lambda d: d.max(1)}[metric](d)
                if others:
                    dist[ids == q_id] = np.inf
                # rows are in order of id: of equal distances the first count
                bound = np.partition(dist, k - 1)[k - 1] if len(dist) > k else np.inf
                at = np.flatnonzero(dist <= bound)
                at = at[np.argsort(dist[at], kind="stable")][:k]
                out += [(q_id, dist[i], ids[i], y[i]) for i in at if dist[i] < np.inf]
        return pd.DataFrame(out, columns=["query_id", "d", "t", "y"])

    types = dict(train.dtypes)
    near = q.groupBy("_a", "_b").cogroup(t.groupBy("_a", "_b")).applyInPandas(run, f"query_id {dict(queries.dtypes)[query_id]}, d double, t {types[train_id]}, y {types[label]}")
    w = Window.partitionBy("query_id").orderBy("d", "t")
    best = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy("query_id", "y").agg(F.sum(1 / (F.col("d") + 1e-12) if weighted else F.lit(1.0)).alias("v"))


def knn(train: DataFrame, queries: DataFrame, k: int, vec: str, label: str, train_id: str, query_id: str, **kw) -> DataFrame:
    """(query_id, predicted): the label with most votes of the k nearest training rows, ties to the smaller label."""
    w = Window.partitionBy("query_id").orderBy(F.desc("v"), "y")
    votes = knn_votes(train, queries, k, vec, label, train_id, query_id, **kw)
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", F.col("y").alias("predicted"))


def gram(df: DataFrame, columns: list[str], y: str) -> tuple[int, np.ndarray, np.ndarray, float]:
    """(n, X'X with a first column of ones, X'y, y'y), in one aggregation of bounded size."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    m = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(cols)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    r = df.dropna(subset=[*columns, y]).agg(*aggs).first()
    a = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    return int(a[0, 0]), a, np.array([r[f"b{i}"] or 0.0 for i in range(m)]), r.yy or 0.0


def ols(df: DataFrame, columns: list[str], y: str) -> np.ndarray:
    """Intercept and coefficients of least squares."""
    _, a, b, _ = gram(df, columns, y)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(df: DataFrame, columns: list[str], y: str, alpha: float) -> np.ndarray:
    """Least squares with alpha added to the coefficients' diagonal; the intercept is free."""
    _, a, b, _ = gram(df, columns, y)
    return np.linalg.solve(a + alpha * np.diag([0.0] + [1.0] * len(columns)), b)


def soft_threshold(x, by):
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def elastic_net(df: DataFrame, columns: list[str], y: str, alpha: float, l1_ratio: float = 1.0, most: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent on (1 / 2n) RSS + alpha (l1_ratio |b| + (1 - l1_ratio) / 2 b^2), from sums; l1_ratio 1 is the lasso."""
    n, a, b, _ = gram(df, columns, y)
    m, my = a[0, 1:] / n, b[0] / n
    xx, xy = a[1:, 1:] / n - np.outer(m, m), b[1:] / n - m * my
    w = np.zeros(len(columns))
    for _ in range(most):
        last = w.copy()
        for j in range(len(w)):
            r = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            d = xx[j, j] + alpha * (1 - l1_ratio)
            w[j] = soft_threshold(r, alpha * l1_ratio) / d if d > 0 else 0.0
        if np.abs(w - last).max(initial=0) < tol:
            break
    return np.r_[my - m @ w, w]


def linear_predict(df: DataFrame, coefficients, columns: list[str], name: str = "predicted") -> DataFrame:
    c = [float(v) for v in coefficients]
    return df.withColumn(name, sum((F.col(k) * v for k, v in zip(columns, c[1:], strict=True)), F.lit(c[0])))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logistic(df: DataFrame, columns: list[str], y: str, rate: float = 0.1, most: int = 1000, tol: float = 1e-6, l2: float = 0.0) -> np.ndarray:
    """Intercept and coefficients by full-batch gradient descent from zero; each step is one aggregation over the different rows,
    which are counted first and kept in Spark's cache."""
    w = np.zeros(len(columns) + 1)
    rows = df.dropna(subset=[*columns, y]).select(*[F.col(c).cast("double") for c in columns], F.col(y).cast("double").alias("_y"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("_n")).persist()
    n = rows.agg(F.sum("_n")).first()[0] or 0
    try:
        for _ in range(most):
            z = sum((F.col(c) * float(v) for c, v in zip(columns, w[1:], strict=True)), F.lit(float(w[0])))
            e = (sigmoid(z) - F.col("_y")) * F.col("_n")
            g = np.array(rows.agg(F.sum(e), *[F.sum(e * F.col(c)) for c in columns]).first(), float) / n
            g[1:] += l2 * w[1:]
            w = w - rate * g
            if np.abs(rate * g).max() < tol:
                break
    finally:
        rows.unpersist()
    return w


def decision_stump(df: DataFrame, columns: list[str], label: str) -> dict:
    """The split of one column at a midpoint between neighbouring values with the least weighted Gini impurity.

    Values are grouped first; running class counts go through each column's different values, range by range. The first
    column and the smallest threshold win ties.
    """
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    names = [f"c{i}" for i in range(len(classes))]
    gini = lambda part, size: size - ratio(sum((p * p for p in part), F.lit(0.0)), size, 0.0)
    best = None
    for k, c in enumerate(columns):
        g = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(*[F.sum(F.when(F.col(label) == y, 1.0).otherwise(0.0)).alias(n) for n, y in zip(names, classes, strict=True)]).persist()
        total = g.agg(*[F.sum(n) for n in names]).first()
        if total[0] is not None:
            left = [F.col(f"run_{n}") for n in names]
            right = [F.lit(t) - x for t, x in zip(total, left, strict=True)]
            nl, nr = sum(left, F.lit(0.0)), sum(right, F.lit(0.0))
            cost = F.round((gini(left, nl) + gini(right, nr)) / sum(total), 15)
            r = running_sums(g, "v", names).where(nr > 0).select(cost.alias("cost"), "v", *left).orderBy("cost", "v").first()
            if r is not None and (best is None or r.cost < best[0]):
                after = g.where(F.col("v") > r.v).agg(F.min("v")).first()[0]
                part = np.array([r[f"run_{n}"] for n in names])
                best = (r.cost, c, (r.v + after) / 2, part, np.array(total, float) - part)
        g.unpersist()
    if best is None:
        return {}
    cost, column, threshold, left, right = best
    return {"column": column, "threshold": threshold, "left": classes[int(left.argmax())], "right": classes[int(right.argmax())], "impurity": cost}


def rule_list(df: DataFrame, rules: list[tuple[list[tuple[str, str, float]], object]], default, name: str = "predicted") -> DataFrame:
    """The label of the first rule all of whose conditions (column, one of < <= > >= == !=, value) hold, else default."""
    import operator

    ops = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    out = F.lit(default)
    for conditions, label in reversed(rules):
        out = F.when(F.coalesce(sum_and([ops[o](F.col(c), F.lit(v)) for c, o, v in conditions]), F.lit(False)), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def sum_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def hash_split(df: DataFrame, key: str, test_share: float, folds: int = 0, seed: int = 0) -> DataFrame:
    """part (train or test) and, if asked for, fold of the training rows, by a seeded hash of the key: rows of one key stay together."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003))
    out = df.withColumn("part", F.when(u < test_share * 1_000_003, "test").otherwise("train"))
    return out.withColumn("fold", F.when(F.col("part") == "train", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(folds)).cast("int"))) if folds else out


def kmeans(df: DataFrame, vec: str, k: int, most: int = 100, tol: float = 1e-6, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd steps from k hashed rows: each step sends k centroids out and takes k sums back. Rows are kept in
    Spark's cache meanwhile, packed in blocks of about a megabyte."""
    v = df.select(F.transform(vec, lambda v: v.cast("double")).alias("v"))
    hashed = v.withColumn("_h", F.xxhash64(F.lit(seed), "v"))
    hashes = [r[0] for r in hashed.select("_h").distinct().orderBy("_h").limit(k).collect()]
    c = np.array([r.v for r in hashed.where(F.col("_h").isin(hashes)).distinct().orderBy("_h").limit(k).collect()])
    rows = v.mapInArrow(_packed, "n int, x binary").persist()
    try:
        return _lloyd(rows, c, most, tol)
    finally:
        rows.unpersist()


def _packed(batches):
    for b in batches:
        if b.num_rows:
            x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
            step = max(1, (1 << 17) // max(1, x.shape[1]))
            parts = [x[i : i + step] for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(p) for p in parts], pa.int32()), "x": pa.array([p.tobytes() for p in parts], pa.binary())})


def _lloyd(rows: DataFrame, c: np.ndarray, most: int, tol: float) -> np.ndarray:
    for _ in range(most):
        def step(batches, c=c):
            total, n = np.zeros_like(c), np.zeros(len(c))
            for b in batches:
                for size, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(size, -1)
                    at = np.stack([((x - m) ** 2).sum(1) for m in c], 1).argmin(1)
                    n += np.bincount(at, minlength=len(c))
                    for k in np.unique(at):
                        total[k] += x[at == k].sum(0)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(c)), pa.int32()), "n": n, "s": pa.array(list(total), pa.list_(pa.float64()))})

        got = rows.mapInArrow(step, "k int, n double, s array<double>").groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(c.shape[1])]).collect()
        new = c.copy()
        for r in got:
            if r.n:
                new[r.k] = [r[f"s{j}"] / r.n for j in range(c.shape[1])]
        shift = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if shift < tol:
            break
    return c


def kmeans_predict(df: DataFrame, centroids: np.ndarray, vec: str, name: str = "cluster") -> DataFrame:
    """The nearest centroid, the first on ties, and the squared distance to it."""
    cost = F.array(*[F.struct((distances(F.col(vec), F.array(*[F.lit(float(v)) for v in c]))["euclidean"] ** 2).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centroids)])
    return df.withColumn("_b", F.array_min(cost)).withColumns({name: F.col("_b")["k"], "sq_distance": F.col("_b")["d"]}).drop("_b")


def pca(df: DataFrame, columns: list[str], components: int) -> dict:
    """Mean, components (rows) and explained variances from the covariance sums; each component's largest entry is positive."""
    n, a, _, _ = gram(df.withColumn("_0", F.lit(0.0)), columns, "_0")
    m = a[0, 1:] / n
    cov = (a[1:, 1:] - n * np.outer(m, m)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    at = np.argsort(values)[::-1][:components]
    v = vectors[:, at].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return {"mean": m, "components": v, "variance": np.maximum(values[at], 0), "ratio": np.maximum(values[at], 0) / max(np.maximum(values, 0).sum(), 1e-300)}


def lda(df: DataFrame, columns: list[str], label: str) -> dict:
    """Classes with linear scores x w + b from class means and the pooled covariance."""
    r = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"v{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]).orderBy(label).collect()
    total, d = sum(x.n for x in r), len(columns)
    pooled = np.zeros((d, d))
    for x in r:
        for i in range(d):
            for j in range(i, d):
                pooled[i, j] += x.n * x[f"v{i}_{j}"]
                pooled[j, i] = pooled[i, j]
    inv = np.linalg.pinv(pooled / max(total - len(r), 1))
    means = np.array([[x[f"m{i}"] for i in range(d)] for x in r])
    return {"classes": [x[label] for x in r], "w": means @ inv, "b": np.array([-0.5 * m @ inv @ m + np.log(x.n / total) for m, x in zip(means, r, strict=True)])}
