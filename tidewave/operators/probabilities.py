"""Scores and probabilities of the fitted models, one row for each class, and what is read off them.

Every model has the size of its classes and columns and becomes one expression; rows never leave the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import classification, statistics


def linear(columns: list[str], w, b: float = 0.0) -> Column:
    return sum((F.col(c) * float(v) for c, v in zip(columns, w, strict=True)), F.lit(float(b)))


def _spread(df: DataFrame, keep: list[str], classes: list, **values: list[Column]) -> DataFrame:
    """keep, label and the named values, a row for each class."""
    rows = [F.struct(F.lit(c).alias("label"), *[v[k].alias(n) for n, v in values.items()]) for k, c in enumerate(classes)]
    kept = df.select(*keep, F.explode(F.array(*rows)).alias("_s"))
    return kept.select(*kept.columns[:-1], "_s.*")


def _softmaxed(df: DataFrame, keep: list[str], classes: list, name: str, scores: list[Column]) -> DataFrame:
    """keep, label, the score under that name and p, a row for each class. Each score and exponential is worked out once a row."""
    d = df.select(*keep, *[s.alias(f"_s{k}") for k, s in enumerate(scores)])
    s = [F.col(f"_s{k}") for k in range(len(scores))]
    d = d.withColumn("_top", F.greatest(*s) if len(s) > 1 else s[0])
    d = d.withColumns({f"_e{k}": F.exp(c - F.col("_top")) for k, c in enumerate(s)})
    e = [F.col(f"_e{k}") for k in range(len(scores))]
    d = d.withColumn("_t", sum(e, F.lit(0.0)))
    return _spread(d, keep, classes, **{name: s, "p": [c / F.col("_t") for c in e]})


def nb_log_joint(model: DataFrame, columns: list[str]) -> tuple[list, list[Column]]:
    """(classes, log joint probability of each) of a gaussian_nb model."""
    classes = sorted(model.collect(), key=lambda r: r.label)
    part = lambda r, c: -0.5 * (math.log(2 * math.pi * r[f"var_{c}"]) + (F.col(c) - r[f"mean_{c}"]) * (F.col(c) - r[f"mean_{c}"]) / r[f"var_{c}"]) if r[f"var_{c}"] > 0 else F.lit(0.0)
    return [r.label for r in classes], [sum((part(r, c) for c in columns), F.lit(math.log(r.prior))) for r in classes]


def nb_proba(df: DataFrame, model: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, label, log_joint and p."""
    classes, logs = nb_log_joint(model, columns)
    return _softmaxed(df, keep, classes, "log_joint", logs)


def lda_proba(df: DataFrame, model: dict, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, label, score (the discriminant) and p."""
    scores = [linear(columns, w, b) for w, b in zip(model["w"], model["b"], strict=True)]
    return _softmaxed(df, keep, model["classes"], "score", scores)


def logistic_proba(df: DataFrame, w: np.ndarray, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, score (the log odds), p and predicted (p >= 0.5) of a binary model."""
    s = linear(columns, w[1:], w[0])
    return df.select(*keep, s.alias("score"), classification.sigmoid(s).alias("p"), (classification.sigmoid(s) >= 0.5).cast("int").alias("predicted"))


def one_vs_rest_proba(df: DataFrame, fit: dict, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, label, score and p: each class's own probability over the sum of all, even shares if that is 0."""
    scores = [linear(columns, w[1:], w[0]) for w in fit.values()]
    own = [classification.sigmoid(s) for s in scores]
    total = sum(own, F.lit(0.0))
    return _spread(df, keep, list(fit), score=scores, p=[F.when(total > 0, o / total).otherwise(1.0 / len(own)) for o in own])


def predicted(proba: DataFrame, keep: list[str], by: str = "p") -> DataFrame:
    """keep and predicted, the label of the greatest value, the smaller label on ties."""
    w = Window.partitionBy(*keep).orderBy(F.desc(by), "label")
    return proba.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keep, F.col("label").alias("predicted"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def knn_proba(train: DataFrame, queries: DataFrame, k: int, vec: str, label: str, train_id: str, query_id: str, weighted: bool = False, **kw) -> DataFrame:
    """query_id, label and p: a class's share of the votes of the k nearest, for all classes of train."""
    votes = classification.knn_votes(train, queries, k, vec, label, train_id, query_id, weighted=weighted, **kw)
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    g = votes.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("_m"), F.sum("v").alias("_t"))
    shares = [F.coalesce(F.element_at("_m", F.lit(c)), F.lit(0.0)) / F.col("_t") for c in classes]
    return _spread(g, ["query_id"], classes, p=shares)


def roc_auc_ovr(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """One row, auc: the mean over the classes of the area of each against the rest; null if one is undefined.

    scores: the score column of each class.
    """
    parts = [classification.roc_auc(df.select((F.col(y) == c).cast("int").alias("_y"), F.col(s).alias("_s")), "_y", "_s") for c, s in scores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.when(F.count("auc") == len(parts), F.avg("auc")).alias("auc"))


def pca_scores(df: DataFrame, model: dict, columns: list[str], keep: list[str], whitened: bool = False) -> DataFrame:
    """keep and pc_1, pc_2, ...: the rows less the mean along each component, over its deviation if whitened."""
    at = lambda v, s: sum(((F.col(c) - float(m)) * (float(x) / s) for c, m, x in zip(columns, model["mean"], v, strict=True)), F.lit(0.0))
    return df.select(*keep, *[at(v, math.sqrt(s) if whitened else 1.0).alias(f"pc_{k}") for k, (v, s) in enumerate(zip(model["components"], model["variance"], strict=True), 1)])


def unstandardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """The inverse of classification.standardize: each column times its deviation (1 if that is 0) plus its mean."""
    return df.withColumns({c: F.col(c) * float(s or 1.0) + float(m) for c, (m, s) in stats.items()})


def rule_hits(df: DataFrame, rules: list, default, classes: list, keep: list[str]) -> DataFrame:
    """keep, predicted, rule (the place of the first that holds, null for the default) and label, p of each class, 1 or 0."""
    d = classification.rule_list(df, rules, default, "_y")
    numbered = classification.rule_list(d, [(conditions, k) for k, (conditions, _) in enumerate(rules)], None, "_k")
    return _spread(numbered, [*keep, F.col("_y").alias("predicted"), F.col("_k").alias("rule")], classes, p=[(F.col("_y") == c).cast("double") for c in classes])


def stump_rules(stump: dict) -> tuple[list, object]:
    """(rules, default) of a decision stump: at or under the threshold left, else right."""
    return [([(stump["column"], "<=", stump["threshold"])], stump["left"])], stump["right"]


def hist_kde(df: DataFrame, bins: int, points: int = 80, by: str = "series_id", x: str = "x") -> tuple[DataFrame, DataFrame]:
    """(histogram, density with expected): the density as counts expected in a bin of the histogram's width."""
    h = statistics.histogram(df, bins, by, x)
    scale = h.groupBy(by).agg((F.sum("count") * F.max(F.col("right") - F.col("left"))).alias("_w"))
    return h, statistics.kde(df, points).join(scale, by).withColumn("expected", F.when(F.col("_w") > 0, F.col("density") * F.col("_w")).otherwise(F.col("density"))).drop("_w")


def time_design(t: Column, degree: int = 1, knots: list[float] | None = None) -> dict[str, Column]:
    """Columns of a growth design: powers t1, t2, ... of time and hinges h1, h2, ..., the time after each knot."""
    powers = {f"t{d}": t if d == 1 else F.pow(t, F.lit(float(d))) for d in range(1, degree + 1)}
    return powers | {f"h{k}": F.greatest(t - knot, F.lit(0.0)) for k, knot in enumerate(knots or [], 1)}


def centred_time(df: DataFrame, t: str, origin: float | None = None) -> tuple[DataFrame, float]:
    """df with t less the origin, the mean time if none is given, and that origin."""
    at = float(df.agg(F.avg(t)).first()[0]) if origin is None else origin
    return df.withColumn(t, F.col(t) - at), at


def uniform(key: Column, seed: int, k: int = 0) -> Column:
    """A number in (0, 1) for each key, the same at every run: the first 32 bits of an MD5 of seed, k and key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit(f"{k}"), key.cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(key: Column, mean: Column | float = 0.0, sd: Column | float = 1.0, seed: int = 0) -> Column:
    """A normal draw for each key, by Box and Muller; the mean itself if sd is not above 0."""
    sd, mean = (c if isinstance(c, Column) else F.lit(float(c)) for c in (sd, mean))
    z = F.sqrt(-2 * F.ln(uniform(key, seed, 0))) * F.cos(2 * math.pi * uniform(key, seed, 1))
    return F.when(sd > 0, mean + sd * z).otherwise(mean)


def gamma(key: Column, shape: int, scale: float = 1.0, seed: int = 0) -> Column:
    """A gamma draw of whole shape for each key, as a sum of exponential ones."""
    return sum((-F.ln(uniform(key, seed, k)) for k in range(shape)), F.lit(0.0)) * scale


def beta(key: Column, a: int, b: int, seed: int = 0) -> Column:
    """A beta draw of whole parameters for each key, from two gamma ones."""
    x, y = gamma(key, a, 1.0, seed), sum((-F.ln(uniform(key, seed, a + k)) for k in range(b)), F.lit(0.0))
    return x / (x + y)


def van_der_pol(x: Column, v: Column, mu: float, omega: float = 1.0, forcing: float = 0.0) -> tuple[Column, Column]:
    """(dx, dv) of the oscillator."""
    return v, mu * (1 - x * x) * v - omega * omega * x + forcing
