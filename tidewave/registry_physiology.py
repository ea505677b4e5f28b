"""Queries of pulse, breath and stride analyses, and the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewave.operators import physiology
from tidewave.registry import WAVE, query, tidy, wave


def _peaks(source: str, gap: int, prominence: float, height: float) -> str:
    """CTEs from wave-like source(series_id, i, x) to pk(series_id, i, n), the kept peaks in order."""
    return f"""ca AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY i)), ma AS (SELECT series_id, i, x FROM ca WHERE x > p AND x > n AND x >= {height}), en AS (SELECT m.series_id, m.i, m.x, coalesce(max(h.i) FILTER (WHERE h.i < m.i), -1) AS l, coalesce(min(h.i) FILTER (WHERE h.i > m.i), 1000000000) AS r FROM ma m LEFT JOIN {source} h ON h.series_id = m.series_id AND h.x > m.x GROUP BY ALL), ba AS (SELECT e.series_id, e.i, e.x - min(v.x) AS prominence FROM en e JOIN {source} v ON v.series_id = e.series_id AND v.i > e.l AND v.i < e.r GROUP BY e.series_id, e.i, e.x), ke AS (SELECT series_id, list_reduce(list([i] ORDER BY i), lambda a, y: CASE WHEN y[1] >= a[len(a)] + {gap} THEN list_concat(a, y) ELSE a END) AS kept FROM ba WHERE prominence >= {prominence} GROUP BY series_id), pk AS (SELECT series_id, unnest(kept) AS i FROM ke), ga AS (SELECT series_id, i, (i - lag(i) OVER w)::DOUBLE AS g, row_number() OVER w AS k FROM pk WINDOW w AS (PARTITION BY series_id ORDER BY i)), gb AS (SELECT *, g - lag(g) OVER (PARTITION BY series_id ORDER BY i) AS d FROM ga)"""


_FIGURES = "round(m, 5) AS mean, round(s, 5) AS std, n / {fs} AS duration_s, coalesce(peaks, 0) AS peaks, round(rate * {fs}, 5) AS mean_rate, round(CASE WHEN ng > 1 THEN sd / {fs} END, 6) AS sdnn, round(CASE WHEN ng > 2 THEN rm / {fs} END, 6) AS rmssd"
_GROUPED = "fi AS (SELECT series_id, count(*) AS peaks, count(g) AS ng, avg(60 / g) AS rate, stddev_pop(g) AS sd, sqrt(avg(d * d)) AS rm FROM gb GROUP BY series_id)"


def _scaled(less: float = 0.0) -> str:
    return f"{WAVE}, sc AS (SELECT series_id, i, x / 50 - {less} AS x FROM wave), su AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS s, count(*)::DOUBLE AS n FROM sc GROUP BY series_id)"


def _signal(t, less: float = 0.0):
    return wave(t).select("series_id", "i", (F.col("x") / 50 - less).alias("x"))


@query(f"{_scaled()}, {_peaks('sc', 2, 0.12, 0.3)}, {_GROUPED} SELECT su.series_id, {_FIGURES.format(fs='5.0')} FROM su LEFT JOIN fi USING (series_id)")
def pulse_analysis(t):
    d = physiology.analyses(_signal(t), 5.0, "pulse")
    return tidy(d.withColumns({c: F.round(c, 5) for c in ("mean", "std", "mean_rate")}))


@query(f"""{_scaled(1.0)}, {_peaks('sc', 4, 0.05, 0.05)}, {_GROUPED}, al AS (SELECT series_id, avg(g) FILTER (WHERE k % 2 = 0) AS gi, avg(g) FILTER (WHERE k > 1 AND k % 2 = 1) AS go FROM ga GROUP BY series_id), ph AS (SELECT series_id, i, x > 0 AS up, i - lag(i) OVER (PARTITION BY series_id, x > 0 ORDER BY i) AS b FROM ca WHERE x > p AND x > n), pg AS (SELECT series_id, count(*) FILTER (WHERE up) AS pi_, count(*) FILTER (WHERE NOT up) AS po, avg(b) FILTER (WHERE up) AS bi, avg(b) FILTER (WHERE NOT up) AS bo FROM ph GROUP BY series_id) SELECT su.series_id, {_FIGURES.format(fs='2.0')}, round(gi / 2, 6) AS interval_in, round(go / 2, 6) AS interval_out, coalesce(pi_, 0) AS peaks_in, coalesce(po, 0) AS peaks_out, round(bi / 2, 6) AS between_in, round(bo / 2, 6) AS between_out FROM su LEFT JOIN fi USING (series_id) LEFT JOIN al USING (series_id) LEFT JOIN pg USING (series_id)""")
def breath_analysis(t):
    d = physiology.analyses(_signal(t, 1.0), 2.0, "breath")
    return tidy(d.withColumns({c: F.round(c, 5) for c in ("mean", "std", "mean_rate")}))


@query(f"""{_scaled()}, {_peaks('sc', 2, 0.08, 0.0)}, st AS (SELECT series_id, count(g) AS ng, avg(g) / 4 AS m, stddev_pop(g) / 4 AS sd FROM ga GROUP BY series_id) SELECT su.series_id, coalesce(ng, 0) AS n_strides, round(st.m, 6) AS mean_stride, round(CASE WHEN ng > 1 THEN sd ELSE 0 END, 6) AS std_stride, round(120 / st.m, 5) AS cadence, round(1.3 * st.m, 6) AS mean_length, round(CASE WHEN ng > 1 THEN 1.3 * sd WHEN ng = 1 THEN 0 END, 6) AS std_length, round(1.3 * st.m / 2, 6) AS mean_step, 1.3::DOUBLE AS speed FROM su LEFT JOIN st USING (series_id)""")
def stride_analysis(t):
    d = physiology.analyses(_signal(t), 4.0, "stride")
    return tidy(d.withColumn("cadence", F.round("cadence", 5)))


def _band(fs: float, kind: str) -> str:
    """The filtered signal fi2(series_id, i, x) of nu(series_id, i, x), sample by sample, twice."""
    lo, hi = physiology.BANDS[kind]
    w0, al = math.pi * (lo + hi) / fs, math.sin(math.pi * (hi - lo) / fs / 2) / (2 * physiology.Q)
    b, a1, a2 = al / (1 + al), -2 * math.cos(w0) / (1 + al), (1 - al) / (1 + al)
    one = f"({b!r}e0 * (n.x - x2) - ({a1!r}e0) * y1 - ({a2!r}e0) * y2)"
    return f"""fb AS (SELECT series_id, i, {b!r}e0 * x AS y1, 0.0e0 AS y2, {b!r}e0 * {b!r}e0 * x AS z1, 0.0e0 AS z2, x AS x1, 0.0e0 AS x2 FROM nu WHERE i = 0 UNION ALL SELECT n.series_id, n.i, {one}, y1, {b!r}e0 * ({one} - y2) - ({a1!r}e0) * z1 - ({a2!r}e0) * z2, z1, n.x, x1 FROM fb JOIN nu n ON n.series_id = fb.series_id AND n.i = fb.i + 1), sc AS (SELECT series_id, i, z1 AS x FROM fb), su AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS s, count(*)::DOUBLE AS n FROM sc GROUP BY series_id)"""


_NUMBERED = "WITH RECURSIVE nu AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 50 AS x FROM events)"


@query(f"{_NUMBERED}, {_band(25.0, 'pulse')}, {_peaks('sc', 10, 0.12, 0.05)}, {_GROUPED} SELECT su.series_id, {_FIGURES.format(fs='25.0')} FROM su LEFT JOIN fi USING (series_id)")
def pulse_quality_analysis(t):
    d = physiology.analyses(_signal(t), 25.0, "pulse", "high")
    return tidy(d.withColumns({c: F.round(c, 5) for c in ("mean", "std", "mean_rate")}))


@query(f"{_NUMBERED}, {_band(20.0, 'stride')}, {_peaks('sc', 12, 0.15, 0.20)} SELECT series_id, k - 1 AS k, round(i / 20.0, 6) AS t, round(g / 20.0, 6) AS interval, round(60 / (g / 20.0), 5) AS rate FROM ga")
def stride_quality_intervals(t):
    d = physiology.intervals(_signal(t), 20.0, "stride", "poor")
    return tidy(d.withColumn("rate", F.round("rate", 5)))
