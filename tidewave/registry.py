"""Queries of the library's own operators over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.functions import special
from tidewave.operators import biosignals, classification, dynamics, explore, load, models, series, signal, spatial, statistics
from tidewave.plans import joins
from tidewave.streaming import vitals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables) under its name, with its SQL if there is one."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null, counts as bigint."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(F.when(~F.isnan(c), c), digits)
            return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name)
        return c.cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else c

    return df.select(*[cell(f) for f in df.schema])


def wave(t) -> DataFrame:
    """events.value of each user as a series."""
    return t("events").select(F.col("user_id").alias("series_id"), (F.row_number().over(series.over(id_="user_id", at=["ts", "event_id"])) - 1).alias("i"), F.col("value").alias("x"))


WAVE = "WITH wave AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"


@query(f"""{WAVE} SELECT series_id, i, round(x, 6) AS x, round(d, 6) AS diff FROM (SELECT *, x - lag(x) OVER (PARTITION BY series_id ORDER BY i) AS d FROM wave) WHERE i > 0""")
def successive_differences(t):
    return tidy(series.successive_differences(wave(t)))


@query(f"""{WAVE} SELECT series_id, i, round(x, 6) AS x, CASE WHEN n = 5 THEN round(m, 6) END AS mean, CASE WHEN n = 5 THEN round(s, 6) END AS std FROM (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM wave WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS 4 PRECEDING))""")
def rolling_stats(t):
    return tidy(series.rolling_std(series.rolling_mean(wave(t), 5), 5))


@query(f"""{WAVE} SELECT series_id, i AS start, round(v, 6) AS value FROM (SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS v FROM wave WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8 AND i % 4 = 0""")
def rolling_apply_range(t):
    return tidy(series.rolling_apply(wave(t), 8, 4, lambda a: F.array_max(a) - F.array_min(a)))


@query("""SELECT b AS bin, count(*) AS n FROM (SELECT (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS b FROM events) GROUP BY b""")
def discretize(t):
    return tidy(t("events").select(series.discretize(F.col("value"), [10.0, 50.0, 100.0]).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")))


@query(f"""{WAVE} SELECT series_id, round(sum(coalesce((x + p) / 2 * 0.5, 0)), 4) AS area FROM (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS p FROM wave) GROUP BY series_id""")
def trapz(t):
    return tidy(series.trapz(wave(t), 0.5), 4)


@query(f"""{WAVE} SELECT series_id, i, round(x, 6) AS x, round(sum(d) OVER (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING), 4) AS area FROM (SELECT *, coalesce((x + lag(x) OVER (PARTITION BY series_id ORDER BY i)) / 2 * 0.5, 0) AS d FROM wave)""")
def cumtrapz(t):
    d = series.cumtrapz(wave(t), 0.5)
    return tidy(d.withColumn("area", F.round("area", 4)))


@query("""SELECT event_type, round(atan2(s, c), 6) AS circular_mean, round(least(sqrt(s * s + c * c), 1), 6) AS resultant_length, round(sqrt(-2 * ln(least(sqrt(s * s + c * c), 1))), 6) AS circular_sd FROM (SELECT event_type, avg(sin(value / 20)) AS s, avg(cos(value / 20)) AS c FROM events GROUP BY event_type)""")
def circular_stats(t):
    return tidy(t("events").groupBy("event_type").agg(*[c.alias(n) for n, c in series.circular(F.col("value") / 20).items()]))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value), 6) AS std_sample, round(stddev_pop(value) / abs(avg(value)), 6) AS cv, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def descriptive(t):
    x, s, e = F.col("value"), statistics, t("events").select("event_type", "value")
    sums = e.groupBy("event_type").agg(s.mean(x).alias("mean"), s.std(x).alias("std"), s.std_sample(x).alias("std_sample"), s.cv(x).alias("cv"))
    return tidy(sums.join(s.percentiles(e, ["event_type"], "value", {"median": 0.5, "p25": 0.25, "p90": 0.9}), "event_type"))


@query(f"""{WAVE}, m AS (SELECT series_id, median(x) AS m FROM wave GROUP BY series_id) SELECT series_id, round(median(abs(x - m)), 6) AS mad FROM wave JOIN m USING (series_id) GROUP BY series_id""")
def median_deviation(t):
    return tidy(statistics.mad(wave(t)))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'corr({min(a, b)}, {max(a, b)})'}, 6) AS r FROM lineitem" + ("" if a != b else " HAVING count(*) > 0") for a in _COLS for b in _COLS) + ")")
def correlation_matrix(t):
    return tidy(statistics.correlation_matrix(t("lineitem"), _COLS))


@query(f"""{WAVE}, c AS (SELECT series_id, i, x - avg(x) OVER (PARTITION BY series_id) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM wave), v AS (SELECT series_id, sum(d * d) AS v FROM c GROUP BY series_id), k AS (SELECT unnest(range(0, 4)) AS lag), s AS (SELECT a.series_id, k.lag, sum(a.d * b.d) AS s FROM k JOIN c a ON true JOIN c b ON a.series_id = b.series_id AND b.i = a.i - k.lag WHERE k.lag < a.n GROUP BY 1, 2) SELECT series_id, lag::BIGINT AS lag, round(CASE WHEN v = 0 THEN 0 ELSE s / v END, 6) AS acf FROM s JOIN v USING (series_id)""")
def autocorrelation(t):
    return tidy(statistics.acf(wave(t), 3))


@query(f"""{WAVE}, w AS (SELECT series_id, i, x, lead(x, 2) OVER (PARTITION BY series_id ORDER BY i) AS y FROM wave), k AS (SELECT unnest(range(0, 4)) AS lag), p AS (SELECT a.series_id, k.lag, b.x AS u, a.y AS v FROM k JOIN w a ON true JOIN w b ON a.series_id = b.series_id AND b.i = a.i - k.lag WHERE a.y IS NOT NULL) SELECT s.series_id, s.lag::BIGINT AS lag, round(coalesce(r, 0), 6) AS r FROM (SELECT DISTINCT series_id, lag FROM wave, k) s LEFT JOIN (SELECT series_id, lag, CASE WHEN count(*) > 1 AND stddev_pop(u) > 0 AND stddev_pop(v) > 0 THEN corr(u, v) END AS r FROM p GROUP BY 1, 2) USING (series_id, lag)""")
def cross_correlation(t):
    w = wave(t).withColumn("y", F.lead("x", 2).over(series.over()))
    return tidy(statistics.ccf(w, "x", "y", 3))


def beats(t) -> DataFrame:
    """Times of each user's events in seconds, ties kept in order."""
    return t("events").select(F.col("user_id").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")


GAPS = "WITH gaps AS (SELECT user_id AS series_id, epoch_us(ts) / 1e6 AS t, row_number() OVER w - 1 AS k, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS interval FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"


@query(f"""{GAPS} SELECT series_id, k, round(t, 3) AS t, round(interval, 3) AS interval, round(CASE WHEN interval > 0 THEN 60 / interval END, 6) AS rate FROM gaps WHERE k > 0""")
def rr_rates(t):
    d = biosignals.intervals(beats(t))
    return d.select("series_id", "k", F.round("t", 3).alias("t"), F.round("interval", 3).alias("interval"), F.round("rate", 6).alias("rate"))


@query(f"""{GAPS}, g AS (SELECT *, abs(interval - lag(interval) OVER (PARTITION BY series_id ORDER BY k)) AS d FROM gaps WHERE k > 0) SELECT series_id, count(*) AS n, round(60 / nullif(avg(interval), 0), 6) AS mean_rate, CASE WHEN count(*) > 1 THEN round(stddev_pop(interval) * 1000, 1) END AS sdnn_ms, CASE WHEN count(*) > 2 THEN round(sqrt(avg(d * d)) * 1000, 1) END AS rmssd_ms, round(coalesce(avg((d > 0.05)::INT) * 100, 0), 6) AS pnn50 FROM g GROUP BY series_id""")
def hrv(t):
    d = biosignals.hrv(biosignals.intervals(beats(t)))
    return tidy(d.withColumns({"sdnn_ms": F.round("sdnn_ms", 1), "rmssd_ms": F.round("rmssd_ms", 1)}))


@query("""SELECT count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(max(abs(e)), 4) AS max_abs_error, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS e FROM lineitem)""")
def regression_report(t):
    d = t("lineitem").agg(*[c.alias(n) for n, c in statistics.errors(F.col("l_extendedprice"), F.col("l_quantity") * 1500).items()])
    return d.select("n", *[F.round(c, k).alias(c) for c, k in (("mae", 4), ("mse", 2), ("rmse", 4), ("bias", 4), ("max_abs_error", 4), ("r2", 6))])


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS u, list_transform(b.embedding, lambda x: x::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_distance(u, v), 6) AS euclidean, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: abs(u[i] - v[i]))), 6) AS manhattan, round(list_max(list_transform(range(1, len(u) + 1), lambda i: abs(u[i] - v[i]))), 6) AS chebyshev, round(1 - list_cosine_similarity(u, v), 6) AS cosine FROM p""")
def vector_distances(t):
    e = t("embeddings")
    j = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return tidy(j.select("vec_id", *[c.alias(n) for n, c in statistics.distances(F.col("embedding"), F.col("next")).items()]))


def _ratings(t) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_suppkey") % 10).alias("subject"), (F.col("l_linenumber") % 3).alias("rater")).agg(F.avg("l_quantity").alias("y"))


@query("""WITH c AS (SELECT l_suppkey % 10 AS s, l_linenumber % 3 AS r, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2), z AS (SELECT count(DISTINCT s)::DOUBLE AS n, count(DISTINCT r)::DOUBLE AS k FROM c), bs AS (SELECT var_pop(m) AS vs, avg(v) AS vw FROM (SELECT avg(y) AS m, var_pop(y) AS v FROM c GROUP BY s)), br AS (SELECT var_pop(m) AS vr FROM (SELECT avg(y) AS m FROM c GROUP BY r)), q AS (SELECT n, k, n * k * vs / (n - 1) AS b, n * k * vw / (n * (k - 1)) AS w, n * k * vr / (k - 1) AS j FROM z, bs, br), e AS (SELECT *, (w * n * (k - 1) - j * (k - 1)) / ((n - 1) * (k - 1)) AS e FROM q) SELECT round((b - w) / (b + (k - 1) * w), 6) AS icc_11, round((b - w) / b, 6) AS icc_1k, round((b - e) / (b + (k - 1) * e + k * (j - e) / n), 6) AS icc_21, round((b - e) / (b + (j - e) / n), 6) AS icc_2k, round((b - e) / (b + (k - 1) * e), 6) AS icc_31, round((b - e) / b, 6) AS icc_3k FROM e""")
def icc(t):
    return tidy(statistics.icc(_ratings(t)))


@query("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT floor((l_extendedprice - lo) / (hi - lo) * (20 - 1e-12))::BIGINT AS bin, count(*) AS n FROM lineitem, r GROUP BY 1) SELECT b.bin::BIGINT AS bin, round(lo + b.bin * ((hi - lo) / 20), 4) AS "left", round(lo + (b.bin + 1) * ((hi - lo) / 20), 4) AS "right", coalesce(n, 0) AS count FROM r, (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN c ON c.bin = b.bin""")
def histogram(t):
    return tidy(statistics.histogram(t("lineitem"), 20, x="l_extendedprice"), 4)


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS q FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""")
def standard_scaler(t):
    d = t("lineitem")
    return tidy(classification.standardize(d, classification.standard_scaler(d, ["l_quantity"])).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")))


@query("""SELECT p_partkey, round((p_size - lo) / (hi - lo), 6) AS size FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)""")
def min_max_scaler(t):
    return tidy(classification.min_max(t("part"), ["p_size"]).select("p_partkey", F.col("p_size").cast("double").alias("size")))


@query("""SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM part JOIN (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand) USING (p_brand)""")
def grouped_range_scale(t):
    return tidy(classification.grouped_range_scale(t("part"), "p_brand", "p_retailprice").select("p_partkey", "scaled"))


def _judged(t) -> DataFrame:
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") > 1500).cast("int").alias("p"), F.col("n_chars").cast("double").alias("score"))


JUDGED = "WITH j AS (SELECT quality, (n_chars > 1500)::INT AS p, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@query(f"""{JUDGED} SELECT quality AS true_class, p AS predicted_class, count(*) AS count FROM j GROUP BY 1, 2""")
def confusion_matrix(t):
    return tidy(classification.confusion(_judged(t), "quality", "p"))


@query(f"""{JUDGED}, c AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, count(*) FILTER (WHERE quality = label AND p = label) AS tp, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE p = label) AS predicted FROM c, j GROUP BY label), r AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM s) SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, support FROM r""")
def classification_report(t):
    return tidy(classification.classification_report(_judged(t), "quality", "p"))


@query(f"""{JUDGED}, c AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, count(*) FILTER (WHERE quality = label AND p = label) AS tp, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE p = label) AS predicted FROM c, j GROUP BY label), r AS (SELECT coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM s) SELECT round((SELECT avg((quality = p)::INT) FROM j), 6) AS accuracy, round(avg(re), 6) AS balanced_accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS macro_f1 FROM r""")
def classification_overall(t):
    return tidy(classification.overall(_judged(t), "quality", "p"))


@query(f"""{JUDGED}, g AS (SELECT score, sum(quality) AS p, sum(1 - quality) AS n FROM j GROUP BY score) SELECT score AS threshold, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr FROM g""")
def roc_curve(t):
    return tidy(classification.roc_curve(_judged(t), "quality", "score").where(F.col("threshold") < float("inf")))


@query(f"""{JUDGED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM j a JOIN j b ON a.quality = 1 AND b.quality = 0""")
def roc_auc(t):
    return tidy(classification.roc_auc(_judged(t), "quality", "score"))


@query("""WITH v AS (SELECT greatest(var_pop(l_quantity), var_pop(l_discount)) * 1e-9 AS e, count(*) AS n FROM lineitem) SELECT l_returnflag AS label, round(count(*) / any_value(n), 6) AS prior, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(var_pop(l_quantity) + any_value(e), 6) AS var_l_quantity, round(var_pop(l_discount) + any_value(e), 6) AS var_l_discount FROM lineitem, v GROUP BY l_returnflag""")
def gaussian_nb(t):
    return tidy(classification.gaussian_nb(t("lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))


@query("""WITH v AS (SELECT greatest(var_pop(l_quantity), var_pop(l_tax)) * 1e-9 AS e, count(*) AS n FROM lineitem), m AS (SELECT l_linestatus AS label, ln(count(*) / any_value(n)) AS prior, avg(l_quantity) AS mq, avg(l_tax) AS mt, var_pop(l_quantity) + any_value(e) AS vq, var_pop(l_tax) + any_value(e) AS vt FROM lineitem, v GROUP BY l_linestatus) SELECT l_orderkey, l_linenumber, (SELECT label FROM m ORDER BY round(prior - 0.5 * (ln(2 * pi() * vq) + (l_quantity - mq) * (l_quantity - mq) / vq) - 0.5 * (ln(2 * pi() * vt) + (l_tax - mt) * (l_tax - mt) / vt), 12) DESC, label LIMIT 1) AS predicted FROM lineitem""")
def nb_predict(t):
    d = t("lineitem")
    return classification.nb_predict(d, classification.gaussian_nb(d, ["l_quantity", "l_tax"], "l_linestatus"), ["l_quantity", "l_tax"], ["l_orderkey", "l_linenumber"])


@query("""WITH d AS (SELECT q.vec_id AS query_id, t.vec_id AS t, t.label AS y, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, t) <= 5), v AS (SELECT query_id, y, count(*) AS v FROM b GROUP BY 1, 2) SELECT query_id, y AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, y) = 1""")
def knn_predict(t):
    e = t("embeddings")
    return tidy(classification.knn(e, e.where("vec_id % 20 = 0"), 5, "embedding", "label", "vec_id", "vec_id", others=True))


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem""")
def ols(t):
    d = t("lineitem")
    a, b = classification.ols(d, ["l_quantity"], "l_extendedprice")
    return d.sparkSession.createDataFrame([(round(float(a), 3), round(float(b), 4))], "intercept double, slope double")


@query("""SELECT round((n * xy - x * y) / (n * xx - x * x + n * 100.0), 6) AS slope FROM (SELECT count(*)::DOUBLE AS n, sum(p_size) AS x, sum(p_retailprice) AS y, sum(p_size * p_retailprice) AS xy, sum(p_size * p_size) AS xx FROM part)""")
def ridge(t):
    d = t("part")
    return d.sparkSession.createDataFrame([(round(float(classification.ridge(d, ["p_size"], "p_retailprice", 100.0)[1]), 6),)], "slope double")


@query("""SELECT * FROM (WITH s AS (SELECT avg(p_size) AS m, avg(p_retailprice) AS my, var_pop(p_size) AS xx, covar_pop(p_size, p_retailprice) AS xy FROM part), w AS (SELECT sign(xy) * greatest(abs(xy) - 1.0, 0) / xx AS w, m, my FROM s) SELECT round(my - m * w, 5) AS intercept, round(w, 6) AS slope FROM w)""")
def lasso(t):
    d = t("part")
    a, b = classification.elastic_net(d, ["p_size"], "p_retailprice", 1.0)
    return d.sparkSession.createDataFrame([(round(float(a), 5), round(float(b), 6))], "intercept double, slope double")


@query(f"""WITH c AS (SELECT l_returnflag AS y, 'l_quantity' AS c, 1 AS k, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', 2, l_discount::DOUBLE FROM lineitem), y AS (SELECT DISTINCT y FROM c), g AS (SELECT c, k, v, y, count(*) AS n FROM c GROUP BY ALL), full_ AS (SELECT a.c, a.k, a.v, y.y, coalesce(n, 0) AS n FROM (SELECT DISTINCT c, k, v FROM c) a CROSS JOIN y LEFT JOIN g ON g.c = a.c AND g.v = a.v AND g.y = y.y), r AS (SELECT *, sum(n) OVER (PARTITION BY c, y ORDER BY v) AS l, sum(n) OVER (PARTITION BY c, y) AS t FROM full_), s AS (SELECT c, k, v, sum(l)::DOUBLE AS nl, sum(t - l)::DOUBLE AS nr, sum(l * l)::DOUBLE AS ll, sum((t - l) * (t - l))::DOUBLE AS rr FROM r GROUP BY c, k, v), b AS (SELECT c, k, v, round((nl - ll / nl + nr - rr / nr) / (nl + nr), 15) AS cost FROM s WHERE nr > 0 ORDER BY cost, k, v LIMIT 1), o AS (SELECT r.y, r.l, r.t - r.l AS right_ FROM r JOIN b ON r.c = b.c AND r.v = b.v) SELECT c AS "column", round((v + (SELECT min(x.v) FROM c x WHERE x.c = b.c AND x.v > b.v)) / 2, 9) AS threshold, (SELECT y FROM o ORDER BY l DESC, y LIMIT 1) AS "left", (SELECT y FROM o ORDER BY right_ DESC, y LIMIT 1) AS "right" FROM b""")
def decision_stump(t):
    d = t("lineitem")
    s = classification.decision_stump(d, ["l_quantity", "l_discount"], "l_returnflag")
    return d.sparkSession.createDataFrame([(s["column"], round(float(s["threshold"]), 9), str(s["left"]), str(s["right"]))], "column string, threshold double, left string, right string")


@query("""WITH RECURSIVE d AS (SELECT (n_chars - 2000) / 2000e0 AS x, toxic AS y FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND toxic IS NOT NULL), r AS (SELECT 0 AS k, 0.0e0 AS a, 0.0e0 AS b, 1.0e0 AS step UNION ALL SELECT k + 1, a - 0.1 * ga, b - 0.1 * gb, greatest(abs(0.1 * ga), abs(0.1 * gb)) FROM (SELECT k, a, b, avg(1 / (1 + exp(-(a + b * x))) - y) AS ga, avg((1 / (1 + exp(-(a + b * x))) - y) * x) AS gb FROM r, d WHERE k < 1000 AND step >= 1e-6 GROUP BY k, a, b)) SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM r ORDER BY k DESC LIMIT 1""")
def logistic_regression(t):
    d = classification.standardize(t("labels").join(t("documents"), "doc_id").withColumn("n", F.col("n_chars").cast("double")), {"n": (2000.0, 2000.0)})
    w = classification.logistic(d, ["n"], "toxic")
    return tidy(d.sparkSession.createDataFrame([tuple(float(v) for v in w)], "intercept double, slope double"))


@query()
def kmeans_clusters(t):
    e = t("embeddings")
    c = classification.kmeans(e, "embedding", 4)
    return classification.kmeans_predict(e, c, "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT covar_samp(l_quantity, l_quantity) AS c00, covar_samp(l_quantity, l_extendedprice) AS c01, covar_samp(l_quantity, l_discount) AS c02, covar_samp(l_quantity, l_tax) AS c03, covar_samp(l_extendedprice, l_quantity) AS c10, covar_samp(l_extendedprice, l_extendedprice) AS c11, covar_samp(l_extendedprice, l_discount) AS c12, covar_samp(l_extendedprice, l_tax) AS c13, covar_samp(l_discount, l_quantity) AS c20, covar_samp(l_discount, l_extendedprice) AS c21, covar_samp(l_discount, l_discount) AS c22, covar_samp(l_discount, l_tax) AS c23, covar_samp(l_tax, l_quantity) AS c30, covar_samp(l_tax, l_extendedprice) AS c31, covar_samp(l_tax, l_discount) AS c32, covar_samp(l_tax, l_tax) AS c33 FROM lineitem), r AS (SELECT 0 AS k, 0.5e0 AS a, 0.5e0 AS b, 0.5e0 AS c, 0.5e0 AS d UNION ALL SELECT k + 1, x0 / n, x1 / n, x2 / n, x3 / n FROM (SELECT *, sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) AS n FROM (SELECT k, c00 * a + c01 * b + c02 * c + c03 * d AS x0, c10 * a + c11 * b + c12 * c + c13 * d AS x1, c20 * a + c21 * b + c22 * c + c23 * d AS x2, c30 * a + c31 * b + c32 * c + c33 * d AS x3 FROM r, m WHERE k < 60))), v AS (SELECT a, b, c, d, a * (c00 * a + c01 * b + c02 * c + c03 * d) + b * (c10 * a + c11 * b + c12 * c + c13 * d) + c * (c20 * a + c21 * b + c22 * c + c23 * d) + d * (c30 * a + c31 * b + c32 * c + c33 * d) AS l, c00 + c11 + c22 + c33 AS total FROM r, m WHERE k = 60), w AS (SELECT 0 AS k, b AS a, -a AS b, 0.01e0 AS c, 0.01e0 AS d FROM v UNION ALL SELECT k + 1, x0 / n, x1 / n, x2 / n, x3 / n FROM (SELECT *, sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) AS n FROM (SELECT k, y0 - p * va AS x0, y1 - p * vb AS x1, y2 - p * vc AS x2, y3 - p * vd AS x3 FROM (SELECT *, y0 * va + y1 * vb + y2 * vc + y3 * vd AS p FROM (SELECT w.k, c00 * w.a + c01 * w.b + c02 * w.c + c03 * w.d AS y0, c10 * w.a + c11 * w.b + c12 * w.c + c13 * w.d AS y1, c20 * w.a + c21 * w.b + c22 * w.c + c23 * w.d AS y2, c30 * w.a + c31 * w.b + c32 * w.c + c33 * w.d AS y3, v.a AS va, v.b AS vb, v.c AS vc, v.d AS vd FROM w, m, v WHERE w.k < 60))))), u AS (SELECT w.a, w.b, w.c, w.d, w.a * (c00 * w.a + c01 * w.b + c02 * w.c + c03 * w.d) + w.b * (c10 * w.a + c11 * w.b + c12 * w.c + c13 * w.d) + w.c * (c20 * w.a + c21 * w.b + c22 * w.c + c23 * w.d) + w.d * (c30 * w.a + c31 * w.b + c32 * w.c + c33 * w.d) AS l, total FROM w, m, v WHERE w.k = 60) SELECT component, round(l, 2) AS variance, round(l / total, 6) AS ratio, round(abs(a), 4) AS quantity, round(abs(b), 4) AS price FROM (SELECT 0::BIGINT AS component, * FROM v UNION ALL SELECT 1, * FROM u)""")
def pca_components(t):
    d = t("lineitem")
    p = classification.pca(d, _COLS, 2)
    rows = [(k, round(float(v), 2), float(r), round(abs(float(c[0])), 4), round(abs(float(c[1])), 4)) for k, (v, r, c) in enumerate(zip(p["variance"], p["ratio"], p["components"], strict=True))]
    return tidy(d.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, quantity double, price double"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 AND l_discount >= 0.05 THEN 'bulk' WHEN l_tax < 0.02 THEN 'light' ELSE 'plain' END AS predicted FROM lineitem""")
def rule_list(t):
    rules = [([("l_quantity", ">", 40.0), ("l_discount", ">=", 0.05)], "bulk"), ([("l_tax", "<", 0.02)], "light")]
    return classification.rule_list(t("lineitem"), rules, "plain").select("l_orderkey", "l_linenumber", "predicted")


@query("""WITH z AS (SELECT event_id, (value - 50) / 20 AS z FROM events), t AS (SELECT event_id, z, 1 / (1 + 0.3275911 * abs(z / sqrt(2.0))) AS t FROM z) SELECT event_id, round(0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2))), 6) AS p FROM t""")
def normal_cdf(t):
    return tidy(t("events").select("event_id", special.normal_cdf((F.col("value") - 50) / 20).alias("p")))


@query(f"""{WAVE} SELECT series_id, i, round((x - lo) / nullif(hi - lo, 0), 6) AS unit, round(coalesce(100 * (x - lo) / nullif(hi - lo, 0), 0), 6) AS percent, round((x - m) / nullif(s, 0), 6) AS z FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM wave WINDOW w AS (PARTITION BY series_id))""")
def normalizations(t):
    d = signal.zscore(signal.scale_to_percent(signal.normalize(wave(t), "unit"), "percent"), "z")
    return tidy(d.drop("x"))


@query(f"""{WAVE} SELECT series_id, i, round(x, 6) AS x, coalesce(CASE WHEN p = 0 THEN abs(x) > 50 ELSE abs(x - p) > 0.5 * abs(p) END, false) AS outlier FROM (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS p FROM wave)""")
def percent_change_outliers(t):
    return tidy(signal.percent_change_outliers(wave(t), 0.5))


@query(f"""{WAVE}, f AS (SELECT a.series_id, a.i, a.x, list(b.x) AS f FROM wave a JOIN wave b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY ALL), m AS (SELECT *, list_median(f) AS m FROM f), d AS (SELECT *, list_median(list_transform(f, lambda v: abs(v - m))) AS mad FROM m) SELECT series_id, i, round(x, 6) AS x, mad > 0 AND abs(x - m) > 3 * mad AS outlier FROM d""")
def local_mad_outliers(t):
    return tidy(signal.local_mad_outliers(wave(t), 3, 3.0))


@query(f"""{WAVE}, b AS (SELECT *, x > 120 AS bad FROM wave), n AS (SELECT *, max(i) FILTER (WHERE NOT bad) OVER (PARTITION BY series_id ORDER BY i) AS p, min(i) FILTER (WHERE NOT bad) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM b) SELECT n.series_id, n.i, round(n.x, 6) AS x, n.bad, round(CASE WHEN NOT n.bad THEN n.x WHEN p IS NULL THEN c.x WHEN q IS NULL THEN a.x ELSE a.x + (c.x - a.x) * (n.i - p) / (q - p) END, 6) AS filled FROM n LEFT JOIN wave a ON a.series_id = n.series_id AND a.i = p LEFT JOIN wave c ON c.series_id = n.series_id AND c.i = q""")
def linear_fill(t):
    return tidy(signal.linear_fill(wave(t).withColumn("bad", F.col("x") > 120), "bad"))


@query(f"""{WAVE} SELECT series_id, i, round(x, 6) AS x FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM wave WINDOW w AS (PARTITION BY series_id ORDER BY i)) WHERE x > p AND x > n AND x >= 20""")
def local_maxima(t):
    return tidy(signal.local_maxima(wave(t), 20.0))


@query(f"""{WAVE}, b AS (SELECT *, i // 10 AS b FROM wave), r AS (SELECT series_id, i, x, row_number() OVER (PARTITION BY series_id, b ORDER BY x, i) AS lo, row_number() OVER (PARTITION BY series_id, b ORDER BY x DESC, i) AS hi FROM b) SELECT series_id, i, round(x, 6) AS x FROM r WHERE lo = 1 OR hi = 1""")
def min_max_decimate(t):
    return tidy(signal.min_max_decimate(wave(t), 10))


TYPES = "WITH c AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS s, (value > 50)::INT AS y FROM events)"


def _states(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("series_id"), (F.row_number().over(series.over(id_="user_id", at=["ts", "event_id"])) - 1).alias("i"), F.col("event_type").alias("s"), (F.col("value") > 50).cast("int").alias("y"))


@query(f"""{TYPES}, h AS (SELECT 1 AS o, n FROM (SELECT count(*) AS n FROM c GROUP BY s) UNION ALL SELECT 2, n FROM (SELECT count(*) AS n FROM c GROUP BY y) UNION ALL SELECT 3, n FROM (SELECT count(*) AS n FROM c GROUP BY s, y)), e AS (SELECT o, -sum(n / t * ln(n / t)) AS h FROM h, (SELECT count(*) AS t FROM c) GROUP BY o) SELECT round(greatest(sum(CASE WHEN o < 3 THEN h ELSE -h END), 0), 6) AS mi FROM e""")
def mutual_information(t):
    return tidy(dynamics.mutual_information_labels(_states(t), "s", "y"))


def _h(*cols: str) -> str:
    return f"(SELECT series_id, -sum(n / m * ln(n / m)) AS h FROM (SELECT series_id, count(*) AS n, any_value(m) AS m FROM d GROUP BY {', '.join(('series_id', *cols))}) GROUP BY series_id)"


@query(f"""{TYPES}, e AS (SELECT series_id, s, y AS p, lead(y) OVER (PARTITION BY series_id ORDER BY i) AS f FROM c), d AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS m FROM e WHERE f IS NOT NULL) SELECT series_id, round(greatest(a.h - b.h - k.h + g.h, 0), 6) AS te FROM {_h('f', 'p')} a JOIN {_h('p')} b USING (series_id) JOIN {_h('f', 'p', 's')} k USING (series_id) JOIN {_h('p', 's')} g USING (series_id)""")
def transfer_entropy(t):
    return tidy(dynamics.transfer_entropy_labels(_states(t), "s", "y"))


@query(f"""{WAVE} SELECT a.series_id, count(*) AS pairs FROM wave a JOIN wave b ON a.series_id = b.series_id AND b.i > a.i AND abs(a.x - b.x) <= 5 GROUP BY a.series_id""")
def recurrence_counts(t):
    return dynamics.recurrence_pairs(wave(t), 5.0).groupBy("series_id").agg(F.count("*").alias("pairs"))


@query(f"""{WAVE}, p AS (SELECT i AS t, x / 20 AS phi FROM wave) SELECT t, round(sqrt(s * s + c * c), 6) AS r FROM (SELECT t, avg(sin(phi)) AS s, avg(cos(phi)) AS c FROM p GROUP BY t)""")
def kuramoto_order(t):
    return tidy(dynamics.kuramoto(wave(t).select("series_id", F.col("i").alias("t"), (F.col("x") / 20).alias("phi"))).select("t", "r"))


@query(f"""{WAVE}, p AS (SELECT series_id, i AS t, x / 20 AS phi FROM wave), m AS (SELECT t, atan2(avg(sin(phi)), avg(cos(phi))) AS q FROM p GROUP BY t) SELECT series_id, round(sqrt(avg(cos(phi - q)) ** 2 + avg(sin(phi - q)) ** 2), 6) AS rho FROM p JOIN m USING (t) GROUP BY series_id""")
def cluster_phase(t):
    return tidy(dynamics.cluster_phase(wave(t).select("series_id", F.col("i").alias("t"), (F.col("x") / 20).alias("phi"))))


@query(f"""{WAVE}, s AS (SELECT *, count(*) OVER w - 1 AS n, sum(x) OVER w - x AS s, sum(x * x) OVER w - x * x AS q FROM wave WINDOW w AS (PARTITION BY series_id)), d AS (SELECT *, sqrt(greatest((q - s * s / n) / (n - 1), 0)) AS sd FROM s WHERE n > 1) SELECT series_id, i, round(exp(-(pow((x - s / n) / sd, 2) / 8)), 5) AS fit FROM d WHERE sd > 1e-6""")
def peer_fit(t):
    return biosignals.peer_fit(wave(t).withColumn("_c", F.count("*").over(signal.whole())).where("_c > 2").drop("_c"), "x").select("series_id", "i", F.round("fit", 5).alias("fit"))


@query("""SELECT user_id AS series_id, round(max(e) - min(e), 3) AS span, round(avg(p), 6) AS mean_p, max(e) - min(e) >= 180 AND avg(p) > 0.8 AS admitted FROM (SELECT user_id, epoch_us(ts) / 1e6 AS e, least(value / 100, 1) AS p FROM events) GROUP BY user_id""")
def event_gate(t):
    d = t("events").select(F.col("user_id").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    return biosignals.event_gate(d).select("series_id", F.round("span", 3).alias("span"), F.round("mean_p", 6).alias("mean_p"), "admitted")


DAYS = "WITH d AS (SELECT c_mktsegment AS series_id, o_orderdate::DATE AS day, sum(o_totalprice) / 1e6 AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _days(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("series_id"), F.col("o_orderdate").cast("date").alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("load"))


@query(f"""{DAYS}, w AS (SELECT *, avg(load) OVER (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING) AS acute, avg(load) OVER (PARTITION BY series_id ORDER BY day ROWS 27 PRECEDING) AS chronic FROM d) SELECT series_id, day, round(load, 6) AS load, round(acute, 6) AS acute, round(chronic, 6) AS chronic, round(acute / chronic, 6) AS acwr, CASE WHEN acute / chronic < 0.8 THEN 'Low' WHEN acute / chronic <= 1.3 THEN 'Moderate' WHEN acute / chronic <= 1.5 THEN 'High' ELSE 'Very High' END AS risk FROM w""")
def acwr_7_28(t):
    return tidy(load.acwr(_days(t)))


@query(f"""{DAYS}, w AS (SELECT *, stddev_pop(load) OVER w AS s, avg(load) OVER w AS m, sum(load) OVER w AS total, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING)) SELECT series_id, day, round(load, 6) AS load, round(CASE WHEN s > 0 THEN m / s ELSE 1 END, 5) AS monotony, round(CASE WHEN s > 0 THEN m / s ELSE 1 END * total, 5) AS strain FROM w WHERE n > 2""")
def monotony_strain(t):
    d = load.monotony_strain(_days(t), window_days=7).withColumn("n", F.row_number().over(series.over(at="day"))).where("n > 2")
    return d.select("series_id", "day", F.round("load", 6).alias("load"), F.round("monotony", 5).alias("monotony"), F.round("strain", 5).alias("strain"))


@query(f"""{DAYS} SELECT series_id, date_trunc('week', day)::DATE AS week, count(*) AS days, round(sum(load), 6) AS total FROM d GROUP BY 1, 2""")
def weekly_rollup(t):
    return tidy(load.weekly(_days(t)))


_RECURSIVE = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM (SELECT c_mktsegment AS series_id, o_orderdate::DATE AS day, sum(o_totalprice) / 1e6 AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)), """


@query(f"""{_RECURSIVE} r AS (SELECT series_id, day, load, k, load / 42 AS f, load / 7 AS a FROM n WHERE k = 1 UNION ALL SELECT n.series_id, n.day, n.load, n.k, f + (n.load - f) / 42, a + (n.load - a) / 7 FROM r JOIN n ON n.series_id = r.series_id AND n.k = r.k + 1) SELECT series_id, day, round(load, 6) AS load, round(f, 6) AS fitness, round(a, 6) AS fatigue, round(f - a, 6) AS form FROM r""")
def ctl_atl_tsb(t):
    return tidy(load.pulse_response(_days(t)))


@query(f"""{_RECURSIVE} r AS (SELECT series_id, day, load, k, load AS e FROM n WHERE k = 1 UNION ALL SELECT n.series_id, n.day, n.load, n.k, 0.25 * n.load + 0.75 * e FROM r JOIN n ON n.series_id = r.series_id AND n.k = r.k + 1) SELECT series_id, day, round(e, 6) AS ewma FROM r""")
def ewma_load(t):
    d = series.ewma(_days(t).select("series_id", F.col("day").alias("i"), F.col("load").alias("x")), 7)
    return tidy(d.select("series_id", F.col("i").alias("day"), "ewma"))


STREAM = "WITH p AS (SELECT l_suppkey AS series_id, row_number() OVER w AS t_s, l_quantity AS power_w, avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS 29 PRECEDING) AS m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))"


def _power(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("series_id"), F.row_number().over(series.over(id_="l_suppkey", at=["l_shipdate", "l_orderkey", "l_linenumber"])).alias("t_s"), F.col("l_quantity").alias("power_w"))


@query(f"""{STREAM}, g AS (SELECT series_id, count(*) AS n, avg(power_w) AS a, max(power_w) AS x, coalesce(avg(m ** 4) FILTER (WHERE t_s >= 30), avg(power_w ** 4)) ** 0.25 AS np, max(t_s)::DOUBLE AS d FROM p GROUP BY series_id) SELECT series_id, n, round(a, 6) AS avg_power, round(x, 6) AS max_power, round(d, 6) AS duration_s, round(np, 6) AS np, round(np / 25, 6) AS intensity, round(d * np * (np / 25) / (25 * 36), 6) AS tss, round(a * d / 1000, 6) AS work_kj FROM g""")
def ride_metrics(t):
    return tidy(load.ride_metrics(_power(t), 25.0))


@query(f"""{STREAM}, w AS (SELECT series_id, t_s, avg(power_w) OVER (PARTITION BY series_id ORDER BY t_s ROWS 4 PRECEDING) AS a, avg(power_w) OVER (PARTITION BY series_id ORDER BY t_s ROWS 19 PRECEDING) AS b FROM p) SELECT series_id, 5::BIGINT AS duration, round(max(a) FILTER (WHERE t_s >= 5), 6) AS best FROM w GROUP BY series_id UNION ALL SELECT series_id, 20, round(max(b) FILTER (WHERE t_s >= 20), 6) FROM w GROUP BY series_id""")
def power_bests(t):
    return tidy(load.power_bests(_power(t).select("series_id", F.col("t_s").alias("i"), F.col("power_w").alias("x")), [5, 20]))


@query(f"""{STREAM}, r AS (SELECT series_id, t_s, t_s - row_number() OVER (PARTITION BY series_id ORDER BY t_s) AS g FROM p WHERE power_w >= 30) SELECT series_id, min(t_s) AS start, max(t_s) AS "end", count(*) AS n FROM r GROUP BY series_id, g HAVING count(*) >= 3""")
def exceedances(t):
    return tidy(load.exceedances(_power(t).select("series_id", F.col("t_s").alias("i"), F.col("power_w").alias("x")), 30.0, 3))


@query(f"""{STREAM}, d AS (SELECT *, lag(power_w) OVER w AS l, lead(t_s) OVER w AS nt FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t_s)), g AS (SELECT series_id, sum(power_w * coalesce(nt - t_s, 0)) AS distance, max(power_w) AS peak, avg(power_w) AS mean, count(*) FILTER (WHERE power_w - l > 0.8) AS u, count(*) FILTER (WHERE power_w - l < -0.8) AS v FROM d GROUP BY series_id) SELECT series_id, round(distance, 4) AS distance, round(peak, 4) AS peak, round(mean, 4) AS mean, u AS accelerations, v AS decelerations, round(distance + 5 * (u + v), 4) AS load FROM g""")
def movement_load(t):
    return tidy(load.movement_load(_power(t).select("series_id", F.col("t_s").cast("double").alias("t"), F.col("power_w").alias("speed"))), 4)


@query("""WITH p AS (SELECT c_custkey, 50 + c_custkey % 60 AS kg, 1.5 + (c_custkey % 50) / 100.0 AS m, 20 + c_custkey % 50 AS age, c_custkey % 2 = 0 AS male FROM customer), b AS (SELECT *, kg / (m * m) AS bmi, CASE WHEN kg / (m * m) > 30 THEN 22.5 * m * m + 0.25 * (kg - 22.5 * m * m) ELSE kg END AS w FROM p), r AS (SELECT *, round(10 * w + 625 * m - 5 * age + CASE WHEN male THEN 5 ELSE -161 END) AS bmr FROM b) SELECT c_custkey, round(bmi, 6) AS bmi, bmr, round(bmr * 1.55) AS tdee, least(500.0, round(bmr * 1.55) - bmr) AS deficit FROM r""")
def nutrition(t):
    k = F.col("c_custkey")
    p = t("customer").select("c_custkey", (50 + k % 60).cast("double").alias("kg"), (1.5 + (k % 50) / 100.0).alias("m"), (20 + k % 50).cast("double").alias("age"), (k % 2 == 0).alias("male"))
    p = p.select("c_custkey", load.bmi(F.col("kg"), F.col("m")).alias("bmi"), load.bmr(F.col("kg"), F.col("m"), F.col("age"), F.col("male")).alias("bmr"))
    p = p.withColumn("tdee", load.tdee(F.col("bmr"), F.lit("moderate")))
    return tidy(p.withColumn("deficit", load.deficit(F.col("bmr"), F.col("tdee"), F.lit("moderate"))))


@query("""WITH h AS (SELECT o_orderstatus AS sport, date_trunc('month', o_orderdate)::DATE AS since, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o.o_orderkey, round(h.v, 2) AS v FROM orders o ASOF LEFT JOIN h ON o.o_orderstatus = h.sport AND o.o_orderdate::DATE >= h.since""")
def asof_join(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    h = o.groupBy("o_orderstatus", F.date_trunc("month", "d").cast("date").alias("since")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return joins.asof(o.select("o_orderkey", "o_orderstatus", "d"), h, "o_orderstatus", "d", "since", ["v"]).select("o_orderkey", "v")


@query("""WITH h AS (SELECT o_orderstatus AS sport, date_trunc('month', o_orderdate)::DATE AS s, CASE WHEN month(o_orderdate) % 2 = 0 THEN (date_trunc('month', o_orderdate) + INTERVAL 10 DAY)::DATE END AS e, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), j AS (SELECT o.o_orderkey, o.o_orderdate::DATE AS d, h.e, h.v FROM orders o ASOF LEFT JOIN h ON o.o_orderstatus = h.sport AND o.o_orderdate::DATE >= h.s) SELECT o_orderkey, round(CASE WHEN v IS NOT NULL AND (e IS NULL OR e > d) THEN v ELSE 50 END, 2) AS ftp, CASE WHEN v IS NOT NULL AND (e IS NULL OR e > d) THEN 'history' ELSE 'fallback' END AS origin FROM j""")
def asof_ftp_resolution(t):
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("sport"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    m = F.date_trunc("month", "d").cast("date")
    h = o.groupBy("sport", m.alias("s"), F.when(F.month("d") % 2 == 0, F.date_add(m, 10)).alias("e")).agg(F.max("o_totalprice").alias("w"))
    out = joins.valid_at(o.select("o_orderkey", "sport", "d"), h, "sport", "d", "s", "e", "w", 50.0, "ftp")
    return out.select("o_orderkey", F.round("ftp", 2).alias("ftp"), "origin")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type AND abs(a.s - b.s) <= 600""")
def session_match_pairs(t):
    e = t("events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    r = e.select("user_id", F.col("event_id").alias("b"), F.col("event_type").alias("tb"), F.col("s").alias("sb"))
    return joins.within(e.withColumnRenamed("event_id", "a"), r, ["user_id"], "s", "sb", 600).where("a < b and event_type <> tb").select("a", "b")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events), n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 1800 THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM n) SELECT user_id, island::BIGINT AS island, count(*) AS events, max(s) - min(s) AS seconds FROM g GROUP BY 1, 2""")
def sessions(t):
    e = t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return joins.islands(e, "user_id", "s", 1800).groupBy("user_id", "island").agg(F.count("*").alias("events"), (F.max("s") - F.min("s")).alias("seconds"))


def _activities(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.lit("cycling").alias("sport"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("start"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("pipeline"), F.lit(None).cast("string").alias("manufacturer"), F.col("value").alias("power"), F.lit(3600.0).alias("duration"))


@query("""WITH a AS (SELECT user_id AS owner, event_id AS id, floor(epoch_us(ts) / 1e6)::BIGINT AS s, lower(event_type) AS p, value AS w FROM events), q AS (SELECT *, CASE WHEN w > 0 THEN 1e6 + least(w, 2000) ELSE 0 END + CASE WHEN contains(p, 'srm') OR contains(p, 'email') THEN 50000 WHEN contains(p, 'quarq') OR contains(p, 'stages') OR contains(p, 'power2max') OR contains(p, 'favero') OR contains(p, 'wahoo') OR contains(p, 'garmin') THEN 40000 WHEN contains(p, 'polar') THEN 10000 ELSE 0 END AS score FROM a), k AS (SELECT owner, list_reduce(list([s] ORDER BY s), lambda x, y: CASE WHEN y[1] > x[len(x)] + 600 THEN list_concat(x, y) ELSE x END) AS seeds FROM (SELECT DISTINCT owner, s FROM a) GROUP BY owner), g AS (SELECT q.*, list_max(list_filter(seeds, lambda x: x <= s)) AS seed FROM q JOIN k USING (owner)) SELECT owner, id, first_value(id) OVER (PARTITION BY owner, seed ORDER BY s, id) AS session, row_number() OVER (PARTITION BY owner, seed ORDER BY score DESC, s, id) = 1 AS is_primary FROM g""")
def session_primary(t):
    return joins.link_sessions(_activities(t))


@query("""SELECT user_id AS owner, ts::DATE AS date, round(sum(value), 4) AS total_tss, (3600.0 * count(*))::DOUBLE AS total_duration_s, count(*) AS ride_count, min(event_type) AS primary_sport FROM events WHERE value > 20 GROUP BY 1, 2""")
def daily_loads(t):
    a = _activities(t).withColumns({"sport": F.col("pipeline"), "tss": F.col("power"), "counts_for_load": F.col("power") > 20})
    return tidy(joins.daily_loads(a), 4)


@query("""SELECT c.c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey) THEN 'BUYER' ELSE c_mktsegment END AS c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer c UNION ALL SELECT 10000000 + s_suppkey, 'SUPPLIER', NULL FROM supplier""")
def catalog_upsert(t):
    c = t("customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    n = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().select("c_custkey", F.lit("BUYER").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    s = t("supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return joins.upsert(c, n.unionByName(s), ["c_custkey"], keep_old=["c_acctbal"])


TRACK = "WITH k AS (SELECT user_id // 15 AS series_id, user_id AS agent_id, row_number() OVER w - 1 AS f, value AS x, lead(value) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), tr AS (SELECT series_id, f::DOUBLE AS t, agent_id, x, y FROM k WHERE y IS NOT NULL)"


def _tracks(t) -> DataFrame:
    """Tracks of all events: 15 users of neighbouring ids make a series, so that a frame's pairs don't grow with the table."""
    w = series.over(id_="user_id", at=["ts", "event_id"])
    e = t("events").select(F.floor(F.col("user_id") / 15).alias("series_id"), (F.row_number().over(w) - 1).cast("double").alias("t"), F.col("user_id").alias("agent_id"), F.col("value").alias("x"), F.lead("value").over(w).alias("y"))
    return e.where("y is not null")


@query(f"""{TRACK}, v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)) SELECT series_id, agent_id, t, round(sqrt(vx * vx + vy * vy), 5) AS speed, round(atan2(vy, vx), 5) AS heading FROM v""")
def derive_speeds(t):
    return tidy(spatial.velocities(_tracks(t)).select("series_id", "agent_id", "t", "speed", "heading"), 5)


@query(f"""{TRACK} SELECT a.series_id, a.t, a.agent_id AS a, b.agent_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) AS distance FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.t = b.t AND a.agent_id < b.agent_id""")
def pairwise_distances(t):
    return tidy(spatial.pair_distances(_tracks(t)), 5)


@query(f"""{TRACK}, d AS (SELECT a.series_id, a.t, a.agent_id, b.agent_id AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.t = b.t AND a.agent_id <> b.agent_id) SELECT series_id, t, agent_id, arg_min(o, (d, o)) AS nearest, round(min(d), 5) AS distance, round(avg(d), 5) AS free_space FROM d GROUP BY 1, 2, 3""")
def nearest_agent(t):
    return tidy(spatial.nearest_agent(_tracks(t)), 5)


@query(f"""{TRACK}, s AS (SELECT series_id, agent_id, t, x, y, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(x) OVER u AS x1, last_value(y) OVER u AS y1 FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t), u AS (PARTITION BY series_id, agent_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT series_id, agent_id, round(coalesce(sum(s), 0), 4) AS length, round(any_value(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 4) AS net FROM s GROUP BY 1, 2""")
def path_length(t):
    return tidy(spatial.path(_tracks(t)).select("series_id", "agent_id", "length", "net"), 4)


@query(f"""{TRACK}, v AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS speed FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), a AS (SELECT *, speed - lag(speed) OVER (PARTITION BY series_id, agent_id ORDER BY t) AS a FROM v) SELECT series_id, agent_id % 3 AS grp, count(DISTINCT agent_id) AS agents, round(sum(CASE WHEN speed IS NULL THEN 0 ELSE speed END) / count(DISTINCT agent_id), 4) AS distance, round(max(speed), 4) AS peak_speed, count(*) FILTER (WHERE a > 0.8) AS accelerations, count(*) FILTER (WHERE a < -0.8) AS decelerations FROM a GROUP BY 1, 2""")
def group_summary(t):
    d = _tracks(t)
    agents = d.select("agent_id").distinct().withColumn("grp", F.col("agent_id") % 3)
    return tidy(spatial.agent_summary(d, agents).drop("mean_speed"), 4)


CARRIER = f"""{TRACK}, v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), fo AS (SELECT series_id, t, avg(x) AS fx, avg(y) AS fy FROM tr GROUP BY 1, 2), s AS (SELECT v.*, fx, fy, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d, coalesce(sqrt(vx * vx + vy * vy), 0) AS speed FROM v JOIN fo ON v.series_id = fo.series_id AND v.t = fo.t), ca AS (SELECT series_id, t, CASE WHEN arg_max(d, (q, -agent_id)) <= 2 THEN arg_max(agent_id, (q, -agent_id)) END AS carrier FROM (SELECT *, 1 / (d + 0.1) + 0.5 * greatest(coalesce(CASE WHEN d > 1e-6 AND speed > 0 THEN (vx * (fx - x) + vy * (fy - y)) / d END, 0), 0) AS q FROM s) GROUP BY series_id, t)"""


@query(f"""{CARRIER} SELECT * FROM ca""")
def ball_carrier(t):
    d = _tracks(t)
    return spatial.carrier(d, d.groupBy("series_id", "t").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy")))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value + 40 END AS hr, CASE WHEN event_id % 3 > 0 THEN 88 + (props->>'k')::DOUBLE % 13 END AS spo2 FROM events) SELECT event_id, CASE WHEN coalesce(hr > 120, false) OR coalesce(spo2 < 90, false) THEN 'Critical' WHEN coalesce(hr > 100 OR hr < 50, false) OR coalesce(spo2 < 94, false) THEN 'Warning' ELSE 'Normal' END AS status FROM v""")
def vitals_status(t):
    k = F.get_json_object("props", "$.k").cast("double")
    hr, o2 = F.when(F.col("event_id") % 5 > 0, F.col("value") + 40), F.when(F.col("event_id") % 3 > 0, 88 + k % 13)
    return t("events").select("event_id", vitals.status(hr, o2).alias("status"))


@query("""SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 10 OFFSET 5""")
def catalog_page(t):
    from tidewave.sources.readers import page

    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return page(j, ["n_name"], 5, 10).select("n_nationkey", "n_name", "r_name")


@query(f"""{WAVE}, w AS (SELECT series_id, i, x AS x0, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM wave WINDOW o AS (PARTITION BY series_id ORDER BY i)), r AS (SELECT series_id, count(*) AS n, stddev_pop(x) AS sd, 0.2 * stddev_pop(x) AS r FROM wave GROUP BY series_id), c AS (SELECT a.series_id, count(*) AS b, count(*) FILTER (WHERE abs(a.x2 - d.x2) <= r) AS a FROM w a JOIN r USING (series_id) JOIN w d ON d.series_id = a.series_id AND d.i > a.i AND a.x2 IS NOT NULL AND d.x2 IS NOT NULL AND abs(a.x0 - d.x0) <= r AND abs(a.x1 - d.x1) <= r GROUP BY a.series_id) SELECT series_id, round(CASE WHEN n > 3 AND sd >= 1e-12 AND a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END, 6) AS sampen FROM r LEFT JOIN c USING (series_id)""")
def sample_entropy(t):
    from tidewave.operators.grouped import summary

    return tidy(summary(wave(t), lambda x: {"sampen": dynamics.sample_entropy(x, 2, 0.2 * x.std())}, "sampen double"))


@query(f"""{WAVE}, e AS (SELECT series_id, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM wave WINDOW o AS (PARTITION BY series_id ORDER BY i)), p AS (SELECT u.series_id, u.i, v.i AS j FROM e u JOIN e v ON u.series_id = v.series_id AND v.i > u.i AND u.c IS NOT NULL AND v.c IS NOT NULL AND sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2 + (u.c - v.c) ** 2) <= 20), n AS (SELECT series_id, greatest(count(*) - 2, 0)::DOUBLE AS n FROM wave GROUP BY series_id), dl AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, j - i AS d, i - row_number() OVER (PARTITION BY series_id, j - i ORDER BY i) AS g FROM p) GROUP BY series_id, d, g), both_ AS (SELECT series_id, i AS r, j AS c FROM p UNION ALL SELECT series_id, j, i FROM p), vl AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, c, r - row_number() OVER (PARTITION BY series_id, c ORDER BY r) AS g FROM both_) GROUP BY series_id, c, g), t AS (SELECT series_id, 2.0 * count(*) AS total FROM p GROUP BY series_id), d AS (SELECT series_id, 2.0 * sum(len) AS s, avg(len) AS m, max(len) AS x FROM dl WHERE len >= 2 GROUP BY series_id), v AS (SELECT series_id, sum(len)::DOUBLE AS s, avg(len) AS m, max(len) AS x FROM vl WHERE len >= 2 GROUP BY series_id), h AS (SELECT series_id, -sum(q * log2(q)) AS h FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS q FROM dl WHERE len >= 2 GROUP BY series_id, len) GROUP BY series_id) SELECT series_id, round(CASE WHEN n > 0 THEN coalesce(total, 0) / (n * n) ELSE 0 END, 6) AS rr, round(coalesce(d.s / total, 0), 6) AS det, round(coalesce(v.s / total, 0), 6) AS lam, round(coalesce(d.m, 0), 6) AS lmean, coalesce(d.x, 0)::BIGINT AS lmax, round(coalesce(v.m, 0), 6) AS tt, coalesce(v.x, 0)::BIGINT AS vmax, round(coalesce(h, 0), 6) AS entropy FROM n LEFT JOIN t USING (series_id) LEFT JOIN d USING (series_id) LEFT JOIN v USING (series_id) LEFT JOIN h USING (series_id)""")
def recurrence_quantification(t):
    from tidewave.operators.grouped import summary

    return tidy(summary(wave(t), lambda x: dynamics.rqa_sparse(dynamics.embed(x, 3, 1), radius=20.0, theiler=1), "rr double, det double, lam double, lmean double, lmax long, tt double, vmax long, entropy double"))


_EVEN = "SELECT user_id AS series_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events"


@query(f"""WITH w AS ({_EVEN}), e AS (SELECT series_id, event_type, i, x AS a, lead(x) OVER (PARTITION BY series_id, event_type ORDER BY i) AS b FROM w), a AS (SELECT * FROM e WHERE event_type = 'click' AND b IS NOT NULL), b AS (SELECT * FROM e WHERE event_type = 'view' AND b IS NOT NULL), n AS (SELECT series_id, n, k FROM (SELECT series_id, count(*)::DOUBLE AS n FROM a GROUP BY 1) JOIN (SELECT series_id, count(*)::DOUBLE AS k FROM b GROUP BY 1) USING (series_id)),
p AS (SELECT a.series_id, a.i, b.i AS j FROM a JOIN b ON a.series_id = b.series_id AND sqrt((a.a - b.a) ** 2 + (a.b - b.b) ** 2) <= 30), t AS (SELECT series_id, count(*)::DOUBLE AS total FROM p GROUP BY 1),
dl AS (SELECT series_id, count(*) AS len FROM (SELECT p.series_id, j - i AS l, i - row_number() OVER (PARTITION BY p.series_id, j - i ORDER BY i) AS g FROM p JOIN n ON n.series_id = p.series_id AND (i <> j OR n.n <> n.k)) GROUP BY series_id, l, g), d AS (SELECT series_id, sum(len)::DOUBLE AS s, avg(len) AS m, max(len) AS x FROM dl WHERE len >= 2 GROUP BY 1),
vl AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, j, i - row_number() OVER (PARTITION BY series_id, j ORDER BY i) AS g FROM p) GROUP BY series_id, j, g), v AS (SELECT series_id, sum(len)::DOUBLE AS s, avg(len) AS m, max(len) AS x FROM vl WHERE len >= 2 GROUP BY 1),
h AS (SELECT series_id, -sum(q * log2(q)) AS h FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS q FROM dl WHERE len >= 2 GROUP BY series_id, len) GROUP BY 1)
SELECT series_id, round(coalesce(total / (n * k), 0), 6) AS rr, round(coalesce(d.s / total, 0), 6) AS det, round(coalesce(v.s / total, 0), 6) AS lam, round(coalesce(d.m, 0), 6) AS lmean, coalesce(d.x, 0)::BIGINT AS lmax, round(coalesce(v.m, 0), 6) AS tt, coalesce(v.x, 0)::BIGINT AS vmax, round(coalesce(h, 0), 6) AS entropy FROM n LEFT JOIN t USING (series_id) LEFT JOIN d USING (series_id) LEFT JOIN v USING (series_id) LEFT JOIN h USING (series_id)""")
def cross_recurrence(t):
    w = F.row_number().over(series.over(id_=["user_id", "event_type"], at=["ts", "event_id"])) - 1
    e = t("events").where(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("series_id"), "event_type", w.alias("i"), F.col("value").alias("x"))
    one = lambda kind: dynamics.embedded(e.where(F.col("event_type") == kind), 2, 1)
    return tidy(dynamics.crqa(one("click"), one("view"), 30.0))


@query(f"""WITH RECURSIVE n AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events), k AS (SELECT series_id, i, x, x AS s, 2.0e0 - 2.0e0 * 2.0e0 / 12.0e0 AS p FROM n WHERE i = 0 UNION ALL SELECT n.series_id, n.i, n.x, s + (p + 1) / (p + 11) * (n.x - s), (1 - (p + 1) / (p + 11)) * (p + 1) FROM k JOIN n ON n.series_id = k.series_id AND n.i = k.i + 1) SELECT series_id, i, round(x, 6) AS x, round(s, 6) AS smooth FROM k""")
def kalman_smoothing(t):
    from tidewave.operators.grouped import per_series

    return tidy(per_series(wave(t), lambda x: signal.random_walk(x, 1.0, 10.0), "smooth"))


@query(f"""{WAVE}, c AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM wave WINDOW w AS (PARTITION BY series_id ORDER BY i)), m AS (SELECT series_id, i, x FROM c WHERE x > p AND x > n), e AS (SELECT m.series_id, m.i, m.x, coalesce(max(h.i) FILTER (WHERE h.i < m.i), -1) AS l, coalesce(min(h.i) FILTER (WHERE h.i > m.i), 1000000000) AS r FROM m LEFT JOIN wave h ON h.series_id = m.series_id AND h.x > m.x GROUP BY ALL), b AS (SELECT e.series_id, e.i, e.x - min(v.x) AS prominence FROM e JOIN wave v ON v.series_id = e.series_id AND v.i > e.l AND v.i < e.r GROUP BY e.series_id, e.i, e.x), k AS (SELECT series_id, list_reduce(list([i] ORDER BY i), lambda a, y: CASE WHEN y[1] >= a[len(a)] + 3 THEN list_concat(a, y) ELSE a END) AS kept FROM b WHERE prominence >= 10 GROUP BY series_id) SELECT b.series_id, b.i, round(prominence, 6) AS prominence FROM b JOIN k ON k.series_id = b.series_id AND list_contains(kept, b.i)""")
def peaks(t):
    from tidewave.operators.grouped import table

    return tidy(table(wave(t), lambda x: dict(zip(("i", "prominence"), signal.find_peaks(x, prominence=10.0, distance=3), strict=True)), "i long, prominence double"))


@query(f"""{WAVE}, s AS (SELECT series_id, count(*) AS n, list(x ORDER BY x) AS v, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM wave GROUP BY series_id), q AS (SELECT *, (v[1 + round_even(0.75 * (n - 1), 0)::INT] - v[1 + round_even(0.25 * (n - 1), 0)::INT]) / 1.34 AS iqr FROM s), b AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE greatest(1.06 * coalesce(least(nullif(sd, 0), nullif(iqr, 0)), 0) * n ** -0.2, (hi - lo) * 0.001) END AS h0 FROM q), c AS (SELECT *, CASE WHEN h0 = 0 THEN 1.0 ELSE h0 END AS h, lo - 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS a, hi + 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS z FROM b), g AS (SELECT *, a + unnest(range(0, 40)) * (z - a) / 39 AS "at" FROM c) SELECT series_id, round("at", 6) AS "at", round(list_sum(list_transform(v, lambda y: exp(-0.5 * (("at" - y) / h) ** 2))) / (n * h * sqrt(2 * pi())), 6) AS density FROM g""")
def density(t):
    return tidy(statistics.kde(wave(t), points=40))


@query(f"""{WAVE}, s AS (SELECT series_id, count(*) AS n, list(x ORDER BY x) AS v, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM wave GROUP BY series_id), q AS (SELECT *, (v[1 + round_even(0.75 * (n - 1), 0)::INT] - v[1 + round_even(0.25 * (n - 1), 0)::INT]) / 1.34 AS iqr FROM s), b AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE greatest(1.06 * coalesce(least(nullif(sd, 0), nullif(iqr, 0)), 0) * n ** -0.2, (hi - lo) * 0.001) END AS h0 FROM q), c AS (SELECT *, CASE WHEN h0 = 0 THEN 1.0 ELSE h0 END AS h, lo - 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS a, hi + 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS z FROM b), g AS (SELECT *, a + unnest(range(0, 40)) * (z - a) / 39 AS "at" FROM c) SELECT series_id, round("at", 6) AS "at", round(list_sum(list_transform(v, lambda y: exp(-0.5 * (("at" - y) / h) ** 2))) / (n * h * sqrt(2 * pi())), 6) AS density, round(list_sum(list_transform(v, lambda y: exp(-0.5 * (("at" - y) / h) ** 2))) / (n * h * sqrt(2 * pi())) * CASE WHEN hi > lo THEN n * (hi - lo) / 12 ELSE 1 END, 5) AS "count" FROM g""")
def density_counts(t):
    d = statistics.kde_counts(wave(t), 12, points=40)
    return tidy(d.withColumn("count", F.round("count", 5)))


@query(f"""{GAPS}, d AS (SELECT series_id, t, interval, min(t) OVER (PARTITION BY series_id) AS t0, max(t) OVER (PARTITION BY series_id) AS t1 FROM gaps WHERE k > 0), w AS (SELECT series_id, t0, unnest(range(0, greatest(floor((t1 - t0 - 86400 + 1e-9) / 43200)::BIGINT + 1, 0))) * 43200 AS k FROM (SELECT DISTINCT series_id, t0, t1 FROM d)) SELECT w.series_id, round(w.t0 + 86400 + k, 3) AS "end", count(*) AS n, round(avg(interval), 3) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(interval), 3) END AS std FROM w JOIN d ON d.series_id = w.series_id AND d.t - d.t0 > k - 1e-9 AND d.t - d.t0 <= k + 86400 + 1e-9 GROUP BY w.series_id, w.t0, k""")
def event_windows(t):
    d = biosignals.rolling_event_grid(biosignals.intervals(beats(t)), length=86400.0, step=43200.0)
    return tidy(d, 3)


@query(f"""{WAVE} SELECT series_id, i, round(avg(x) OVER w, 6) AS average, round(quantile_cont(x, 0.5) OVER w, 6) AS median FROM wave WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def smoothing_filters(t):
    return tidy(explore.median_filter(explore.moving_average(wave(t), 2, "average"), 2, "median").drop("x"))


@query(f"""{WAVE}, a AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY series_id ORDER BY i), 0) AS d1, x - avg(x) OVER (PARTITION BY series_id) AS y FROM wave) SELECT series_id, i, round(d1, 6) AS d1, round(coalesce(d1 - lag(d1) OVER (PARTITION BY series_id ORDER BY i), 0), 6) AS d2, round(y, 6) AS y FROM a""")
def derivatives(t):
    return tidy(explore.detrend_mean(explore.derivatives(wave(t))).drop("x"))


@query(f"""{WAVE} SELECT series_id, count(*) AS n, round(avg(x), 6) AS mean, round(arg_max(x, i), 6) AS last FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i DESC) AS k FROM wave) WHERE k <= 30 GROUP BY series_id""")
def ring_statistics(t):
    return tidy(explore.ring_statistics(wave(t), 30))


@query("""SELECT * FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders)""")
def catalog_counts(t):
    return explore.counts({k: t(k) for k in ("orders", "customer", "events")})


@query("""WITH k AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 AS foot, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS step, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6, 2) OVER w AS stride FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT series_id, avg(stride) AS m, stddev_pop(stride) AS s, avg(step) FILTER (WHERE foot = 1) AS l, avg(step) FILTER (WHERE foot = 0) AS r FROM k GROUP BY series_id) SELECT series_id, round(m, 3) AS mean_stride, round(s / m, 5) AS cv_stride, round(120 / m, 6) AS cadence, round(2 * abs(l - r) / (l + r), 5) AS symmetry FROM g""")
def gait_measures(t):
    d = biosignals.gait_measures(beats(t))
    return d.select("series_id", *[F.round(c, k).alias(c) for c, k in (("mean_stride", 3), ("cv_stride", 5), ("cadence", 6), ("symmetry", 5))])


@query(f"""{TRACK}, v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), s AS (SELECT *, sqrt(vx * vx + vy * vy) AS s FROM v), p AS (SELECT *, lag(vx) OVER w AS lx, lag(vy) OVER w AS ly, lag(s) OVER w AS ls, max(s) OVER (PARTITION BY series_id, agent_id) AS top FROM s WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)) SELECT series_id, agent_id, t, round(((vx - lx) * lx + (vy - ly) * ly) / nullif(ls, 0), 5) AS along_accel, round(coalesce(s / nullif(top, 0), 0), 6) AS relative FROM p""")
def along_track_and_pace(t):
    d = _tracks(t)
    a = spatial.along_track(d).select("series_id", "agent_id", "t", F.round("along_accel", 5).alias("along_accel"))
    p = spatial.peak_pace(d).select("series_id", "agent_id", "t", F.round("relative", 6).alias("relative"))
    return a.join(p, ["series_id", "agent_id", "t"])


@query(f"""{TRACK}, d AS (SELECT a.series_id, a.t, a.agent_id AS a, b.agent_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.t = b.t AND a.agent_id < b.agent_id), c AS (SELECT *, (lag(d) OVER w - d) / (t - lag(t) OVER w) AS c FROM d WINDOW w AS (PARTITION BY series_id, a, b ORDER BY t)) SELECT series_id, a, b, round(avg(c), 6) AS closing FROM c GROUP BY 1, 2, 3""")
def pairwise_closing(t):
    return tidy(spatial.closing(_tracks(t)))


@query(f"""{TRACK}, v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), h AS (SELECT series_id, t, agent_id, atan2(vy, vx) AS h FROM v WHERE vx * vx + vy * vy > 0), g AS (SELECT a.series_id, a.agent_id AS a, b.agent_id AS b, avg(cos(a.h - b.h)) AS c, avg(sin(a.h - b.h)) AS s FROM h a JOIN h b ON a.series_id = b.series_id AND a.t = b.t AND a.agent_id < b.agent_id GROUP BY 1, 2, 3) SELECT series_id, a, b, round(sqrt(c * c + s * s), 6) AS r, CASE WHEN sqrt(c * c + s * s) < 0.5 THEN 'mix' WHEN abs(atan2(s, c)) <= pi() / 4 THEN 'in' WHEN abs(atan2(s, c)) >= 3 * pi() / 4 THEN 'opp' ELSE 'out' END AS relation FROM g""")
def directional_phase(t):
    return tidy(spatial.directional_phase(_tracks(t)).drop("mean_angle"))


@query(f"""{TRACK}, v AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), a AS (SELECT series_id, t, agent_id, s - lag(s) OVER (PARTITION BY series_id, agent_id ORDER BY t) AS a FROM v), f AS (SELECT * FROM a WHERE a IS NOT NULL) SELECT u.series_id, u.agent_id AS a, v.agent_id AS b, round(avg((u.a * v.a > 0)::INT), 6) AS together, round(avg((u.a * v.a < 0)::INT), 6) AS against FROM f u JOIN f v ON u.series_id = v.series_id AND u.t = v.t AND u.agent_id < v.agent_id GROUP BY 1, 2, 3""")
def effort_phase(t):
    return tidy(spatial.effort_phase(_tracks(t)).drop("t"))


@query("""WITH d AS (SELECT p_size::DOUBLE AS u, p_retailprice AS y FROM part), z AS (SELECT (u - mid) / half AS u, y - my AS y FROM d, (SELECT (min(u) + max(u)) / 2 AS mid, (max(u) - min(u)) / 2 AS half, avg(y) AS my FROM d)), a AS (SELECT *, u - avg(u) OVER () AS p1, u * u - avg(u * u) OVER () AS q2, u * u * u - avg(u * u * u) OVER () AS q3 FROM z), b AS (SELECT *, q2 - p1 * (sum(q2 * p1) OVER () / sum(p1 * p1) OVER ()) AS p2, q3 - p1 * (sum(q3 * p1) OVER () / sum(p1 * p1) OVER ()) AS r3 FROM a), c AS (SELECT *, r3 - p2 * (sum(r3 * p2) OVER () / sum(p2 * p2) OVER ()) AS p3 FROM b), s AS (SELECT count(*)::DOUBLE AS n, sum(y * y) AS r0, sum(y * p1) ** 2 / sum(p1 * p1) AS c1, sum(y * p2) ** 2 / sum(p2 * p2) AS c2, sum(y * p3) ** 2 / sum(p3 * p3) AS c3 FROM c), e AS (SELECT unnest([0, 1, 2, 3]) AS degree, unnest([r0, r0 - c1, r0 - c1 - c2, r0 - c1 - c2 - c3]) AS rss, n FROM s) SELECT degree::BIGINT AS degree, round(rss, 2) AS rss, round(n * ln(rss / n) + 2 * (degree + 1), 4) AS aic, round(n * ln(rss / n) + ln(n) * (degree + 1), 4) AS bic FROM e""")
def polynomial_degrees(t):
    fits = models.polynomial_search(t("part").withColumn("s", F.col("p_size").cast("double")), "s", "p_retailprice", 3)
    d = t("part").sparkSession.createDataFrame([(f["degree"], float(f["rss"]), float(f["aic"]), float(f["bic"])) for f in fits], "degree int, rss double, aic double, bic double")
    return tidy(d.withColumn("rss", F.round("rss", 2)), 4)


@query(f"""WITH n AS (SELECT count(*) AS n, least(greatest(floor(0.2 * count(*) + 0.5)::BIGINT, 1), count(*) - 1) AS test FROM orders), f AS (SELECT unnest(range(0, 5)) AS fold, n - test AS train FROM n) SELECT 'test' AS part, NULL::BIGINT AS fold, test::BIGINT AS n FROM n UNION ALL SELECT 'train', fold, train // 5 + (fold < train % 5)::BIGINT FROM f""")
def train_test_split(t):
    return tidy(models.train_test_split(t("orders").select("o_orderkey"), ["o_orderkey"], 0.2, folds=5).groupBy("part", "fold").agg(F.count("*").alias("n")))


@query(f"""{WAVE}, e AS (SELECT series_id, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM wave WINDOW o AS (PARTITION BY series_id ORDER BY i)), m1 AS (SELECT u.series_id, u.i, arg_min(v.i, (abs(u.a - v.a), v.i)) AS j FROM e u JOIN e v ON u.series_id = v.series_id AND abs(u.i - v.i) > 1 AND u.b IS NOT NULL AND v.b IS NOT NULL GROUP BY u.series_id, u.i), f1 AS (SELECT u.series_id, sum((coalesce(abs(sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2) - abs(u.a - v.a)) / nullif(abs(u.a - v.a), 0) > 10, u.b <> v.b) OR abs(u.b - v.b) > 30)::INT) AS bad FROM m1 JOIN e u ON u.series_id = m1.series_id AND u.i = m1.i JOIN e v ON v.series_id = m1.series_id AND v.i = m1.j GROUP BY u.series_id), m2 AS (SELECT u.series_id, u.i, arg_min(v.i, (sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2), v.i)) AS j FROM e u JOIN e v ON u.series_id = v.series_id AND abs(u.i - v.i) > 1 AND u.c IS NOT NULL AND v.c IS NOT NULL GROUP BY u.series_id, u.i), f2 AS (SELECT u.series_id, sum((coalesce(abs(sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2 + (u.c - v.c) ** 2) - sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2)) / nullif(sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2), 0) > 10, u.c <> v.c) OR abs(u.c - v.c) > 30)::INT) AS bad FROM m2 JOIN e u ON u.series_id = m2.series_id AND u.i = m2.i JOIN e v ON v.series_id = m2.series_id AND v.i = m2.j GROUP BY u.series_id) SELECT n.series_id, round(f1.bad / (n - 1), 6) AS fnn_1, round(f2.bad / (n - 2), 6) AS fnn_2 FROM (SELECT series_id, count(*) AS n FROM wave GROUP BY series_id) n LEFT JOIN f1 USING (series_id) LEFT JOIN f2 USING (series_id)""")
def false_neighbors(t):
    from tidewave.operators.grouped import summary

    return tidy(summary(wave(t), lambda x: {f"fnn_{m}": dynamics.fnn(x, m, 1, 10.0, 30.0, 1) for m in (1, 2)}, "fnn_1 double, fnn_2 double"))


_READY = f"""{_RECURSIVE} r AS (SELECT series_id, day, load, k, load / 42 AS f, load / 7 AS a FROM n WHERE k = 1 UNION ALL SELECT n.series_id, n.day, n.load, n.k, f + (n.load - f) / 42, a + (n.load - a) / 7 FROM r JOIN n ON n.series_id = r.series_id AND n.k = r.k + 1)"""


@query(f"""{_READY}, w AS (SELECT series_id, day, f, a, f - a AS form, avg(load) OVER (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING) / avg(load) OVER (PARTITION BY series_id ORDER BY day ROWS 27 PRECEDING) AS q, greatest(a, 0) / greatest(f, 1e-6) AS s FROM r), p AS (SELECT series_id, day,
    CASE WHEN form <= -20 THEN 1 + 0.5 * least(-20 - form, 40) / 40 WHEN form < 0 THEN 0.55 * least(form / -20, 1) ELSE 0.15 * exp(-form / 30) END + CASE WHEN s >= 1.15 THEN 0.35 + 0.5 * least(s - 1.15, 0.5) WHEN s <= 0.95 THEN -0.15 ELSE 0 END + CASE WHEN q >= 1.3 THEN 0.55 + 0.6 * least(q - 1.3, 0.8) WHEN q <= 0.8 THEN -0.1 ELSE 0 END AS rec,
    CASE WHEN abs(form) <= 12 THEN 1 - 0.35 * abs(form) / 12 WHEN abs(form) <= 30 THEN 0.65 - 0.25 * (abs(form) / 12 - 1) ELSE 0.15 END + CASE WHEN s >= 1.15 THEN -0.05 ELSE 0 END + CASE WHEN q >= 1.3 THEN 0.25 + 0.2 * least(q - 1.3, 0.8) ELSE 0 END AS keep,
    CASE WHEN form >= 10 THEN 1 + 0.35 * least((form - 10) / 25, 1) WHEN form > 0 THEN form / 10 * 0.7 ELSE 0.08 * greatest(1 + form / 40, 0) END + CASE WHEN s >= 1.15 THEN -0.4 - 0.6 * least(s - 1.15, 0.5) WHEN s <= 0.95 THEN 0.2 + 0.4 * least(0.95 - s, 0.4) ELSE 0 END + CASE WHEN q >= 1.3 THEN -1.1 - 0.9 * least(q - 1.3, 0.8) WHEN q <= 0.8 THEN 0.25 + 0.35 * least(0.8 - q, 0.5) ELSE 0 END AS more FROM w), g AS (SELECT series_id, day, greatest(rec, 0) AS rec, greatest(keep, 0) AS keep, greatest(more, 0) AS more FROM p)
    SELECT series_id, day, CASE WHEN rec >= keep AND rec >= more THEN 'recovery' WHEN keep >= more THEN 'maintenance' ELSE 'overload' END AS goal, round(least(greatest((list_sort([rec, keep, more])[3] - list_sort([rec, keep, more])[2]) / 1.2, 0.15), 1), 5) AS confidence, round(rec, 5) AS recovery, round(keep, 5) AS maintenance, round(more, 5) AS overload FROM g""")
def goal_suggestions(t):
    d = load.suggest_goals(load.acwr(load.pulse_response(_days(t))))
    return d.select("series_id", "day", "goal", *[F.round(c, 5).alias(c) for c in ("confidence", *load.GOALS)])


@query(f"""{_READY}, e AS (SELECT series_id, arg_max(f, k) AS f, arg_max(a, k) AS a, max(load) AS top, avg(load) FILTER (WHERE k > m - 28) AS c0 FROM r JOIN (SELECT series_id, max(k) AS m FROM r GROUP BY series_id) USING (series_id) GROUP BY series_id), c AS (SELECT *, CASE WHEN c0 > 1 THEN c0 ELSE 50.0 END AS c, greatest(greatest(top, CASE WHEN c0 > 1 THEN c0 ELSE 50.0 END) * 1.5, 1) AS most FROM e), u AS (SELECT unnest([0.0, 0.25, 0.45, 0.70, 1.0, 1.20, 1.40])::DOUBLE AS u, unnest(range(0, 7)) AS ix), x AS (SELECT series_id, f, a, c, u1.ix + 7 * u2.ix + 49 * u3.ix AS ix, least(u1.u * c, most) AS d1, least(u2.u * c, most) AS d2, least(u3.u * c, most) AS d3 FROM c CROSS JOIN u u1 CROSS JOIN u u2 CROSS JOIN u u3),
    y AS (SELECT *, (d1 + d2 + d3) / 3 AS mean, greatest(c, 1) AS k FROM x), z AS (SELECT *, mean / k AS share, list_aggregate([d1, d2, d3], 'stddev_pop') / CASE WHEN mean < 1e-9 THEN 1 ELSE mean END AS cv, ((f + (d1 - f) / 42) + (d2 - (f + (d1 - f) / 42)) / 42) AS f2, ((a + (d1 - a) / 7) + (d2 - (a + (d1 - a) / 7)) / 7) AS a2 FROM y), v AS (SELECT *, (f2 + (d3 - f2) / 42) - (a2 + (d3 - a2) / 7) AS form_end, f - a AS form_start, f * (41 / 42.0) ** 3 - a * (6 / 7.0) ** 3 - (f - a) AS best FROM z),
    g AS (SELECT *, 'recovery' AS goal, share BETWEEN 0.2 - 1e-12 AND 0.55 + 1e-12 AS ok, 1.2 * abs(share - 0.38) + 0.8 * list_avg(list_transform([d1, d2, d3], lambda w: abs(w - greatest(0.38 * k, 1)) / greatest(0.38 * k, 1))) + CASE WHEN (d1 < 1)::INT + (d2 < 1)::INT + (d3 < 1)::INT = 3 THEN 0.4 ELSE 0 END - CASE WHEN form_end > form_start THEN 0.03 * least(CASE WHEN best > 1e-6 THEN (form_end - form_start) / best ELSE 1 END, 1) ELSE 0 END AS cost FROM v
    UNION ALL SELECT *, 'maintenance', share BETWEEN 0.85 - 1e-12 AND 1.15 + 1e-12, 0.5 * abs(share - 1) + 0.55 * abs(CASE WHEN mean >= 1e-9 THEN cv ELSE 0 END - 0.28) + CASE WHEN (greatest(d1, d2, d3) - least(d1, d2, d3)) / greatest(mean, 1) < 0.08 THEN 0.45 ELSE 0 END + 0.4 * list_sum(list_transform([d1, d2, d3], lambda w: greatest(0.3 - w / k, 0) + greatest(w / k - 1.35, 0))) FROM v
    UNION ALL SELECT *, 'overload', share BETWEEN 1.15 - 1e-12 AND 1.4 + 1e-12 AND mean > k, 1.1 * abs(share - 1.25) + 0.45 * list_avg(list_transform([d1, d2, d3], lambda w: abs(w - greatest(1.25 * k, 1)) / greatest(1.25 * k, 1))) + CASE WHEN least(d1, d2, d3) + 1e-9 >= 1.2 * k THEN 0.2 ELSE 0 END + CASE WHEN form_end > form_start + 1 THEN 0.1 ELSE 0 END FROM v)
    SELECT series_id, goal, round(d1, 4) AS day_1, round(d2, 4) AS day_2, round(d3, 4) AS day_3, ok AS success, round(cost, 5) AS score, round(form_end, 4) AS form_end, round(share, 5) AS load_share FROM g QUALIFY row_number() OVER (PARTITION BY series_id, goal ORDER BY NOT ok, trunc(cost * 1e6), ix) = 1""")
def load_plans(t):
    d = load.plans(_days(t), horizon=3)
    return d.select("series_id", "goal", *[F.round(F.col("loads")[k], 4).alias(f"day_{k + 1}") for k in range(3)], "success", F.round("score", 5).alias("score"), F.round("form_end", 4).alias("form_end"), F.round("load_share", 5).alias("load_share"))


from tidewave import registry_catalog, registry_control, registry_events, registry_folds, registry_mixed, registry_models, registry_physiology, registry_spatial, registry_store  # noqa: E402, F401
