"""Queries of systems, spectra and information flow, and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewave.operators import control, dynamics, signal
from tidewave.operators.grouped import summary, table
from tidewave.registry import WAVE, _states, query, tidy, wave

_LABELS = "WITH c AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS s, (value > 50)::INT AS y, event_id % 3 AS z FROM events), d AS (SELECT * FROM (SELECT series_id, s, z, y AS p, lead(y) OVER (PARTITION BY series_id ORDER BY i) AS f FROM c) WHERE f IS NOT NULL)"


def _h(*cols: str) -> str:
    return f"(SELECT series_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT series_id, count(*) AS n FROM d GROUP BY {', '.join(('series_id', *cols))}) GROUP BY series_id)"


def _flow(given: list[str], sources: list[str]) -> str:
    z = ["p", *given]
    return f"{_LABELS} SELECT series_id, round(greatest(a.h - b.h - c1.h + e.h, 0), 6) AS te FROM {_h('f', *z)} a JOIN {_h(*z)} b USING (series_id) JOIN {_h('f', *z, *sources)} c1 USING (series_id) JOIN {_h(*z, *sources)} e USING (series_id)"


def _labelled(t):
    e = t("events").select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("event_type").alias("s"), (F.col("value") > 50).cast("int").alias("y"), (F.col("event_id") % 3).alias("z"))
    from tidewave.operators.series import over

    return e.withColumn("i", F.row_number().over(over(at=["ts", "event_id"])) - 1)


@query(_flow(["z"], ["s"]))
def transfer_entropy_conditional(t):
    return tidy(control.transfer_entropy_given(_labelled(t), ["s"], "y", ["z"]))


@query(_flow([], ["s", "z"]))
def transfer_entropy_multivariate(t):
    return tidy(control.transfer_entropy_given(_labelled(t), ["s", "z"], "y"))


@query("""WITH RECURSIVE n AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events), k AS (SELECT series_id, i, x, 0.0e0 + (1001.0e0 / 1011.0e0) * 0 AS dummy, 0.0e0 AS l, 0.0e0 AS d, 1000.0e0 AS a, 0.0e0 AS b, 1000.0e0 AS c FROM (SELECT series_id, -1 AS i, 0.0e0 AS x FROM n WHERE i = 0) UNION ALL SELECT n.series_id, n.i, n.x, 0.0e0, l + d + (a + 2 * b + c + 1) / (a + 2 * b + c + 11) * (n.x - l - d), d + (b + c) / (a + 2 * b + c + 11) * (n.x - l - d), (1 - (a + 2 * b + c + 1) / (a + 2 * b + c + 11)) * (a + 2 * b + c + 1), (1 - (a + 2 * b + c + 1) / (a + 2 * b + c + 11)) * (b + c), (c + 0.01) - (b + c) / (a + 2 * b + c + 11) * (b + c) FROM k JOIN n ON n.series_id = k.series_id AND n.i = k.i + 1) SELECT series_id, i, round(l, 5) AS level, round(d, 5) AS drift FROM k WHERE i >= 0""")
def linear_trend(t):
    def run(x: np.ndarray) -> dict:
        s = control.local_linear_trend(x, 1.0, 1.0, 0.01, 10.0)["x"]
        return {"i": np.arange(len(x)), "level": s[:, 0], "drift": s[:, 1]}

    return tidy(table(wave(t), run, "i long, level double, drift double"), 5)


@query(f"""{WAVE}, n AS (SELECT series_id, count(*) AS n, least(count(*), 32) AS l FROM wave GROUP BY series_id), g AS (SELECT series_id, n, l, unnest(range(0, n - l + 1, greatest(l - l // 2, 1))) AS a FROM n), s AS (SELECT g.series_id, g.a, g.l, w.x * (CASE WHEN l = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (w.i - a) / (l - 1)) END) AS v, w.i - a AS k FROM g JOIN wave w ON w.series_id = g.series_id AND w.i >= a AND w.i < a + l), f AS (SELECT series_id, a, l, m, sum(v * cos(2 * pi() * k * m / l)) AS re, sum(v * sin(2 * pi() * k * m / l)) AS im FROM (SELECT *, unnest(range(0, l // 2 + 1)) AS m FROM s) GROUP BY ALL), e AS (SELECT l, sum(power(CASE WHEN l = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * k / (l - 1)) END, 2)) AS e FROM (SELECT l, unnest(range(0, l)) AS k FROM (SELECT DISTINCT l FROM n)) GROUP BY l) SELECT series_id, round(CASE WHEN f.l // 2 > 0 THEN m * 0.5 / (f.l // 2) ELSE 0 END, 6) AS f, round(avg(re * re + im * im) / any_value(e) * CASE WHEN m > 0 AND m < f.l // 2 THEN 2 ELSE 1 END, 4) AS density FROM f JOIN e ON e.l = f.l GROUP BY series_id, f.l, m""")
def power_spectrum(t):
    d = table(wave(t), lambda x: dict(zip(("f", "density"), signal.welch(x, 1.0, 32), strict=True)), "f double, density double")
    return d.select("series_id", F.round("f", 6).alias("f"), F.round("density", 4).alias("density"))


@query("""WITH RECURSIVE v AS (SELECT user_id AS series_id, row_number() OVER w - 1 AS i, value / 50 AS x, lead(value) OVER w / 50 AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT series_id, i, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY i)), g AS (SELECT series_id, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(nx * x) AS p, sum(nx * y) AS q, sum(ny * x) AS r, sum(ny * y) AS u, count(*) AS n FROM s WHERE nx IS NOT NULL GROUP BY series_id), m AS (SELECT series_id, (p * c - q * b) / (a * c - b * b) AS m11, (q * a - p * b) / (a * c - b * b) AS m12, (r * c - u * b) / (a * c - b * b) AS m21, (u * a - r * b) / (a * c - b * b) AS m22 FROM g WHERE n > 3), k AS (SELECT s.series_id, s.i, s.x, s.y, s.x AS hx, s.y AS hy FROM s JOIN m USING (series_id) WHERE i = 0 UNION ALL SELECT s.series_id, s.i, s.x, s.y, m11 * hx + m12 * hy, m21 * hx + m22 * hy FROM k JOIN m ON m.series_id = k.series_id JOIN s ON s.series_id = k.series_id AND s.i = k.i + 1) SELECT series_id, round(avg(sqrt((hx - x) ** 2 + (hy - y) ** 2) / greatest(sqrt(x * x + y * y), 1e-15)), 4) AS error FROM k GROUP BY series_id""")
def dmd_error(t):
    def run(x: np.ndarray) -> dict:
        s = control.snapshots(dynamics.embed(x / 50, 2, 1)) if len(x) > 1 else np.zeros((2, 0))
        return {"error": control.dmd_error(dynamics.dmd(s), s) if s.shape[1] > 4 else float("nan")}

    return tidy(summary(wave(t), run, "error double").where(~F.isnan("error")), 4)


@query(f"""WITH RECURSIVE n AS ({WAVE.split('AS (', 1)[1][:-1]}), r AS (SELECT series_id, i, x, 1.0e0 AS p, 0.0e0 AS v FROM n WHERE i = 0 UNION ALL SELECT n.series_id, n.i, n.x, 0.9 * r.p + 0.1 * r.v + 0.005 * r.x, 0.8 * r.v + 0.1 * r.x FROM r JOIN n ON n.series_id = r.series_id AND n.i = r.i + 1) SELECT series_id, i, round(p, 6) AS "position", round(v + 0.5 * x, 6) AS moved FROM r""")
def linear_response(t):
    system = control.LinearSystem(np.array([[0.9, 0.1], [0.0, 0.8]]), np.eye(2), np.array([[0.005], [0.1]]), np.array([[0.0], [0.5]]))
    return tidy(system.responses(wave(t), [1.0, 0.0], ["position", "moved"]))
