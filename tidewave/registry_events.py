"""Queries of event windows, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import event_windows, series
from tidewave.registry import query, tidy


def _events_sql(name: str, gap: int, shift: int, early: int) -> str:
    return f"{name} AS (SELECT user_id AS series_id, ({gap} * i - {shift} - CASE WHEN value > {early} THEN 1 ELSE 0 END)::DOUBLE AS t, 1 + 0.1 * cos(i / 5.0) + CASE WHEN value > 180 THEN 2 ELSE 0 END AS prominence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))"


_LEFT, _RIGHT = (4, 0, 120), (6, 2, 150)


def _streams(t):
    """Two streams of each user's events: beats of whole seconds, so that windows begin and end with events; what the values
    are makes some come early and some stronger."""
    i = F.row_number().over(series.over(id_="user_id", at=["ts", "event_id"]))
    e = t("events").select(F.col("user_id").alias("series_id"), i.alias("i"), "value")

    def one(gap: int, shift: int, early: int):
        at = gap * F.col("i") - shift - F.when(F.col("value") > early, 1).otherwise(0)
        return e.select("series_id", at.cast("double").alias("t"), (1 + 0.1 * F.cos(F.col("i") / 5.0) + F.when(F.col("value") > 180, 2.0).otherwise(0.0)).alias("prominence"))

    return one(*_LEFT), one(*_RIGHT)


def _scored(name: str, events: str, grid: str) -> str:
    """CTEs that end in <name>sc_, the scored intervals, and <name>r, the repaired ones."""
    p = "PARTITION BY series_id, en"
    moments = lambda x, n: f"(sum({x}) OVER ({p}) - {x}) / ({n} - 1) AS m_, ((sum({x} * {x}) OVER ({p}) - {x} * {x}) - (sum({x}) OVER ({p}) - {x}) ** 2 / ({n} - 1)) / ({n} - 2) AS v_"
    fit = lambda x: f"CASE WHEN sqrt(greatest(v_, 0)) <= 1e-12 THEN CASE WHEN abs({x} - m_) <= 1e-12 THEN 1.0 ELSE 0.0 END ELSE exp(-((({x} - m_) / sqrt(greatest(v_, 0))) ** 2) / 8) END"
    return f"""{name}w AS (SELECT * FROM (SELECT g.series_id, en, t, prominence, count(*) OVER (PARTITION BY g.series_id, en) AS n, max(t) OVER (PARTITION BY g.series_id, en) - min(t) OVER (PARTITION BY g.series_id, en) AS span FROM {grid} g JOIN {events} e ON e.series_id = g.series_id AND t >= en - 180 - 1e-9 AND t <= en + 1e-9) WHERE n >= 4),
{name}d AS (SELECT series_id, en, t, prominence, n, span, t - lag(t) OVER ({p} ORDER BY t) AS iv, {fit("prominence")} AS df FROM (SELECT *, {moments("prominence", "n")} FROM {name}w)),
{name}sc_ AS (SELECT series_id, en, t, iv, prominence, span, df, pf, least(df, pf) AS pr FROM (SELECT *, {fit("iv")} AS pf FROM (SELECT *, {moments("iv", "(n - 1)")} FROM {name}d WHERE iv IS NOT NULL))),
{name}a AS (SELECT *, avg(pr) OVER ({p}) AS mp, last_value(CASE WHEN pr >= 0.6 THEN t END IGNORE NULLS) OVER b AS ta, last_value(CASE WHEN pr >= 0.6 THEN iv END IGNORE NULLS) OVER b AS va, first_value(CASE WHEN pr >= 0.6 THEN t END IGNORE NULLS) OVER f AS tb, first_value(CASE WHEN pr >= 0.6 THEN iv END IGNORE NULLS) OVER f AS vb FROM {name}sc_ WINDOW b AS ({p} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({p} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name}r AS (SELECT series_id, en, t, pr, mp, CASE WHEN pr >= 0.6 THEN iv ELSE va + (t - ta) / (tb - ta) * (vb - va) END AS v, row_number() OVER ({p} ORDER BY t) AS i, row_number() OVER ({p} ORDER BY t DESC) AS back FROM (SELECT *, max((ta IS NULL OR tb IS NULL)::INT) OVER ({p}) AS open_ FROM {name}a) WHERE span >= 180 AND mp > 0.8 AND open_ = 0)"""


_L = _events_sql("e", *_LEFT)
_BOTH = f"{_L}, {_events_sql('o', *_RIGHT)}"
_GRID = "b AS (SELECT series_id, min(t) AS f, max(t) AS l FROM e GROUP BY series_id), g AS (SELECT series_id, f + 180 + unnest(range(0, floor((l - f - 180 + 1e-9) / 30)::BIGINT + 1)) * 30 AS en FROM b)"
_JOINT = "b AS (SELECT series_id, greatest(e.f, o.f) AS f, least(e.l, o.l) AS l FROM (SELECT series_id, min(t) AS f, max(t) AS l FROM e GROUP BY 1) e JOIN (SELECT series_id, min(t) AS f, max(t) AS l FROM o GROUP BY 1) o USING (series_id)), g AS (SELECT series_id, f + 180 + unnest(range(0, floor((l - f - 180 + 1e-9) / 30)::BIGINT + 1)) * 30 AS en FROM b)"


@query(f"WITH {_L}, {_GRID}, {_scored('a', 'e', 'g')} SELECT series_id, round(en, 6) AS until, round(t, 6) AS t, round(iv, 6) AS interval_s, round(pf, 6) AS peer_fit, round(df, 6) AS detector_fit, round(pr, 6) AS probability, round(span, 6) AS span FROM asc_")
def event_interval_scores(t):
    e = _streams(t)[0]
    d = event_windows.scores(event_windows.windows(e, event_windows.bounds(e)))
    return tidy(d.select("series_id", F.col("end").alias("until"), "t", F.col("interval").alias("interval_s"), "peer_fit", "detector_fit", "probability", "span"))


@query(f"WITH {_L}, {_GRID}, {_scored('a', 'e', 'g')} SELECT series_id, round(en, 6) AS until, round(t, 6) AS t, round(v, 6) AS repaired, round(pr, 6) AS probability, round(mp, 6) AS mean_probability FROM ar")
def repair_event_window(t):
    e = _streams(t)[0]
    d = event_windows.repaired(event_windows.scores(event_windows.windows(e, event_windows.bounds(e))))
    return tidy(d.select("series_id", F.col("end").alias("until"), "t", F.col("value").alias("repaired"), "probability", "mean_probability"))


@query(f"""WITH {_L}, {_GRID}, {_scored('a', 'e', 'g')}, m AS (SELECT series_id, en, count(*) AS n, stddev_pop(v) AS sd, avg(v) AS mean, any_value(mp) AS mp FROM ar GROUP BY 1, 2), dd AS (SELECT series_id, en, sqrt(sum(d * d) / count(d)) AS rmssd FROM (SELECT *, v - lag(v) OVER (PARTITION BY series_id, en ORDER BY t) AS d FROM ar) GROUP BY 1, 2),
x AS (SELECT series_id, en, i, v AS p, lead(v) OVER w AS q, lead(v, 2) OVER w AS r FROM ar WINDOW w AS (PARTITION BY series_id, en ORDER BY t)), c AS (SELECT u.series_id, u.en, count(*) AS b, sum((abs(u.r - v.r) <= 0.2 * sd)::INT) AS a FROM x u JOIN x v ON u.series_id = v.series_id AND u.en = v.en AND u.i < v.i AND u.r IS NOT NULL AND v.r IS NOT NULL JOIN m ON m.series_id = u.series_id AND m.en = u.en WHERE abs(u.p - v.p) <= 0.2 * sd AND abs(u.q - v.q) <= 0.2 * sd GROUP BY 1, 2),
h AS (SELECT series_id, en, count(*) AS n_step, avg(iv) AS mi, CASE WHEN count(*) > 1 THEN stddev_pop(iv) END AS si, avg(pr) AS ms, CASE WHEN count(*) > 1 THEN stddev_pop(pr) END AS ss FROM asc_ WHERE t > en - 30 + 1e-9 AND t <= en + 1e-9 GROUP BY 1, 2)
SELECT g.series_id, round(g.en, 6) AS until, n, round(CASE WHEN n >= 3 THEN rmssd END, 6) AS rmssd, round(sd / abs(mean), 6) AS cv, round(CASE WHEN n IS NULL THEN NULL WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END, 6) AS sample_entropy, round(mp, 6) AS mean_probability, n_step, round(mi, 6) AS mean_interval, round(si, 6) AS std_interval, round(ms, 6) AS mean_step, round(ss, 6) AS std_step
FROM g LEFT JOIN m USING (series_id, en) LEFT JOIN dd USING (series_id, en) LEFT JOIN c USING (series_id, en) LEFT JOIN h USING (series_id, en)""")
def rolling_event_measures(t):
    return tidy(event_windows.rolling_measures(_streams(t)[0]).withColumnRenamed("end", "until"))


@query(f"""WITH {_BOTH}, {_JOINT}, {_scored('a', 'e', 'g')}, {_scored('c', 'o', 'g')}, z AS (SELECT series_id, en, least(x.n, y.n) AS n FROM (SELECT series_id, en, count(*) AS n FROM ar GROUP BY 1, 2) x JOIN (SELECT series_id, en, count(*) AS n FROM cr GROUP BY 1, 2) y USING (series_id, en)),
xs AS (SELECT series_id, en, n, n - back + 1 AS i, v FROM ar JOIN z USING (series_id, en) WHERE back <= n), ys AS (SELECT series_id, en, n, n - back + 1 AS i, v FROM cr JOIN z USING (series_id, en) WHERE back <= n),
r AS (SELECT series_id, en, any_value(n) AS n, 0.2 * stddev_pop(v) AS r FROM (SELECT * FROM xs UNION ALL SELECT * FROM ys) GROUP BY 1, 2 HAVING any_value(n) >= 2),
x3 AS (SELECT *, lead(v) OVER w AS v2, lead(v, 2) OVER w AS v3 FROM xs WINDOW w AS (PARTITION BY series_id, en ORDER BY i)), y3 AS (SELECT *, lead(v) OVER w AS v2, lead(v, 2) OVER w AS v3 FROM ys WINDOW w AS (PARTITION BY series_id, en ORDER BY i)),
q AS (SELECT x.series_id, x.en, r.n, x.i, y.i AS j, abs(x.v - y.v) <= r AND abs(x.v2 - y.v2) <= r AND x.v3 IS NOT NULL AND y.v3 IS NOT NULL AS mb, abs(x.v3 - y.v3) <= r AS ma, sqrt((x.v - y.v) ** 2 + (x.v2 - y.v2) ** 2) <= r AS near_ FROM x3 x JOIN y3 y ON x.series_id = y.series_id AND x.en = y.en AND x.v2 IS NOT NULL AND y.v2 IS NOT NULL JOIN r ON r.series_id = x.series_id AND r.en = x.en),
se AS (SELECT series_id, en, count(*) FILTER (WHERE mb) AS b, count(*) FILTER (WHERE mb AND ma) AS a, count(*) FILTER (WHERE near_)::DOUBLE AS total FROM q GROUP BY 1, 2),
dl AS (SELECT series_id, en, count(*) AS len FROM (SELECT series_id, en, j - i AS l, i - row_number() OVER (PARTITION BY series_id, en, j - i ORDER BY i) AS u FROM q WHERE near_ AND i <> j) GROUP BY series_id, en, l, u HAVING count(*) >= 2),
d AS (SELECT series_id, en, sum(len)::DOUBLE AS s, avg(len) AS m FROM dl GROUP BY 1, 2), hh AS (SELECT series_id, en, -sum(w * log2(w)) AS h FROM (SELECT series_id, en, count(*) / sum(count(*)) OVER (PARTITION BY series_id, en) AS w FROM dl GROUP BY series_id, en, len) GROUP BY 1, 2),
vl AS (SELECT series_id, en, sum(len)::DOUBLE AS s FROM (SELECT series_id, en, count(*) AS len FROM (SELECT series_id, en, j, i - row_number() OVER (PARTITION BY series_id, en, j ORDER BY i) AS u FROM q WHERE near_) GROUP BY series_id, en, j, u HAVING count(*) >= 2) GROUP BY 1, 2)
SELECT g.series_id, round(g.en, 6) AS until, r.n AS n_intervals, round(CASE WHEN r.n IS NULL THEN NULL WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END, 6) AS cross_sample_entropy, round(CASE WHEN r.n IS NOT NULL THEN coalesce(total, 0) / ((r.n - 1) * (r.n - 1)) END, 6) AS rr, round(CASE WHEN r.n IS NOT NULL THEN coalesce(d.s / total, 0) END, 6) AS det, round(CASE WHEN r.n IS NOT NULL THEN coalesce(vl.s / total, 0) END, 6) AS lam, round(CASE WHEN r.n IS NOT NULL THEN coalesce(d.m, 0) END, 6) AS mean_diag, round(CASE WHEN r.n IS NOT NULL THEN coalesce(h, 0) END, 6) AS diag_entropy
FROM g LEFT JOIN r USING (series_id, en) LEFT JOIN se USING (series_id, en) LEFT JOIN d USING (series_id, en) LEFT JOIN hh USING (series_id, en) LEFT JOIN vl USING (series_id, en)""")
def rolling_joint_coupling(t):
    return tidy(event_windows.rolling_joint_coupling(*_streams(t)).withColumnRenamed("end", "until"))
