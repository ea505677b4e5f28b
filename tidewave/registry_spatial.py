"""Queries of trajectories: actions, vectors, frames, triangles and windows, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import spatial
from tidewave.registry import CARRIER, TRACK, _tracks, query, tidy

_ACTIONS = f"""{CARRIER},
b AS (SELECT s.*, agent_id % 2 AS grp, row_number() OVER w AS k, count(*) OVER (PARTITION BY series_id, agent_id) AS kn, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM s WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)),
h AS (SELECT *, CASE WHEN k > 1 AND k < kn AND vx * vx + vy * vy > 1e-18 AND dx * dx + dy * dy > 1e-18 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0 END AS fwd FROM b),
ti AS (SELECT ca.*, row_number() OVER w AS k, count(*) OVER (PARTITION BY ca.series_id) AS n, lag(carrier) OVER w AS last_carrier, lag(t) OVER w AS last_t FROM ca WINDOW w AS (PARTITION BY ca.series_id ORDER BY t)),
e AS (SELECT h.*, ti.carrier, c.x AS cx, c.y AS cy, c.grp AS own, l.x AS bx, l.y AS by_ FROM h JOIN ti ON ti.series_id = h.series_id AND ti.t = h.t LEFT JOIN h c ON c.series_id = ti.series_id AND c.t = ti.t AND c.agent_id = ti.carrier LEFT JOIN h l ON l.series_id = ti.series_id AND l.t = ti.last_t AND l.agent_id = ti.last_carrier),
f AS (SELECT *, coalesce(agent_id = carrier, false) AS ball, coalesce(agent_id <> carrier AND sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 12, false) AS near FROM e),
m AS (SELECT f.series_id, f.t, f.agent_id, min(sqrt((f.x - o.x) ** 2 + (f.y - o.y) ** 2)) AS gap FROM f JOIN f o ON o.series_id = f.series_id AND o.t = f.t AND o.near AND o.agent_id <> f.agent_id AND o.grp <> f.grp WHERE f.near OR f.ball GROUP BY ALL),
g AS (SELECT f.*, coalesce(gap, 1e300) AS gap FROM f LEFT JOIN m ON m.series_id = f.series_id AND m.t = f.t AND m.agent_id = f.agent_id),
a AS (SELECT *, CASE WHEN near AND coalesce(sqrt((lx - bx) ** 2 + (ly - by_) ** 2) > 12.6, false) AND gap < 7 AND speed > 0.6 THEN 'Pressure'
    WHEN ball THEN CASE WHEN fwd > 0.72 AND speed > 2.8 AND gap > 3.5 AND greatest(fwd, 0) > 0.55 THEN CASE WHEN fwd > 0.85 AND speed > 4 AND gap > 6 THEN 'Conversion' ELSE 'Creation' END WHEN fwd > 0.6 AND speed > 0.5 AND gap > 6 THEN 'Penetration' WHEN abs(fwd) < 0.5 AND speed > 0.25 THEN 'Expansion' WHEN gap < 6 AND speed > 0.7 THEN 'Pressure' ELSE 'Neutral' END
    WHEN near AND grp = own THEN CASE WHEN fwd > 0.4 AND fwd > 0.45 AND speed > 2.2 AND gap > 4.5 THEN 'Creation' WHEN fwd > 0.3 AND speed > 0.3 THEN 'Penetration' ELSE 'Expansion' END
    WHEN near THEN CASE WHEN fwd > 0.3 AND gap < 7.5 THEN 'Prevention' WHEN gap < 5 THEN 'Pressure' WHEN speed > 0.6 THEN 'Denial' ELSE 'Neutral' END ELSE 'Neutral' END AS action,
    CASE WHEN ball OR near THEN least(0.3 + 0.4 * least(speed / 5, 1) + CASE WHEN gap > 10 THEN 0.3 ELSE 0 END, 1) ELSE 0 END AS confidence FROM g),
tr2 AS (SELECT DISTINCT p.series_id, p.t, p.carrier AS agent_id FROM ti p JOIN ti q ON q.series_id = p.series_id AND q.k = p.k + 1 AND p.carrier <> q.carrier JOIN h r ON r.series_id = q.series_id AND r.t = q.t AND r.agent_id = q.carrier JOIN h o ON o.series_id = q.series_id AND o.t = q.t AND o.agent_id <> r.agent_id AND o.grp <> r.grp AND sqrt((o.x - r.x) ** 2 + (o.y - r.y) ** 2) < 7)"""


@query(f"""{_ACTIONS} SELECT a.series_id, a.t, a.agent_id, CASE WHEN tr2.agent_id IS NOT NULL AND action IN ('Penetration', 'Creation', 'Conversion') THEN 'Neutral' ELSE action END AS action, round(confidence, 6) AS confidence FROM a LEFT JOIN tr2 ON tr2.series_id = a.series_id AND tr2.t = a.t AND tr2.agent_id = a.agent_id""")
def space_actions(t):
    d = _tracks(t)
    agents = d.select("agent_id").distinct().select("agent_id", (F.col("agent_id") % 2).alias("grp"), F.lit(1.0).alias("att_x"), F.lit(0.0).alias("att_y"))
    return tidy(spatial.classify_actions(d, d.groupBy("series_id", "t").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy")), agents))


@query(f"""{TRACK} SELECT series_id, agent_id, t, round(x + y, 6) AS sum_x, round(x - y, 6) AS minus_x, round(2 * x * y, 6) AS dot, round(sqrt(x * x + y * y), 6) AS norm, round(x * x + y * y, 6) AS squared, round(CASE WHEN x * x + y * y > 0 THEN x * (1 / sqrt(x * x + y * y)) ELSE 0 END, 6) AS unit_x, round(acos(greatest(least(2 * x * y / (sqrt(x * x + y * y) * sqrt(x * x + y * y) + 1e-12), 1), -1)), 4) AS angle FROM tr""")
def vector_algebra(t):
    x, y = F.col("x"), F.col("y")
    d = _tracks(t).select("series_id", "agent_id", "t", (x + y).alias("sum_x"), spatial.minus(x, y, y, x)[0].alias("minus_x"), spatial.dot(x, y, y, x).alias("dot"), F.hypot("x", "y").alias("norm"), spatial.dot(x, y, x, y).alias("squared"), spatial.unit(x, y)[0].alias("unit_x"), F.round(spatial.angle_between(x, y, y, x), 4).alias("angle"))
    return tidy(d)


@query(f"""{TRACK}, f AS (SELECT series_id, t, avg(x) AS fx, avg(y) AS fy FROM tr GROUP BY 1, 2), d AS (SELECT tr.*, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d, atan2(fy - y, fx - x) AS b FROM tr JOIN f ON f.series_id = tr.series_id AND f.t = tr.t), m AS (SELECT a.series_id, a.t, a.agent_id, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS far, count(*) AS n FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.t = b.t GROUP BY ALL) SELECT d.series_id, d.t, d.agent_id, round(d, 6) AS distance, round(CASE WHEN d > 1e-9 THEN b ELSE 0 END, 5) AS bearing, row_number() OVER (PARTITION BY d.series_id, d.t ORDER BY round(d, 9), d.agent_id) = 1 AS on_ball, n, round(far, 6) AS farthest FROM d JOIN m ON m.series_id = d.series_id AND m.t = d.t AND m.agent_id = d.agent_id""")
def frame_context(t):
    d = _tracks(t)
    c = spatial.focal_context(d, d.groupBy("series_id", "t").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy")))
    m = spatial.distance_matrix(d).select("series_id", "t", "agent_id", F.size("distances").cast("long").alias("n"), F.array_max(F.map_values("distances")).alias("farthest"))
    c = c.select("series_id", "t", "agent_id", "distance", F.round(F.when(F.col("distance") > 1e-9, F.col("bearing")).otherwise(0.0), 5).alias("bearing"), "on_ball")
    return tidy(c.join(m, ["series_id", "t", "agent_id"]))


@query(f"""{TRACK}, f AS (SELECT series_id, t, avg(x) AS fx, avg(y) AS fy FROM tr GROUP BY 1, 2), k5 AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.series_id, tr.t ORDER BY sqrt((x - fx) ** 2 + (y - fy) ** 2), agent_id) AS r FROM tr JOIN f ON f.series_id = tr.series_id AND f.t = tr.t QUALIFY r <= 5), j AS (SELECT a.series_id, a.t, a.agent_id AS a, b.agent_id AS b, c.agent_id AS c, a.r AS ra, b.r AS rb, c.r AS rc, greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2), sqrt((c.x - a.x) ** 2 + (c.y - a.y) ** 2)) AS edge, abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS area FROM k5 a JOIN k5 b ON b.series_id = a.series_id AND b.t = a.t AND b.r > a.r JOIN k5 c ON c.series_id = a.series_id AND c.t = a.t AND c.r > b.r) SELECT series_id, t, a, b, c, round(edge, 6) AS edge FROM j WHERE edge <= 60 AND area >= 2 QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY edge, ra, rb, rc) <= 4""")
def attack_triangles(t):
    d = _tracks(t)
    return tidy(spatial.local_triangles(d, d.groupBy("series_id", "t").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy")), 5, 60.0))


@query(f"""{TRACK}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), c AS (SELECT *, sum(s) OVER (PARTITION BY series_id, agent_id ORDER BY t) AS c FROM s), e AS (SELECT a.series_id, a.agent_id, a.t, a.x, a.y, a.c, min(b.t) AS et FROM c a JOIN c b ON b.series_id = a.series_id AND b.agent_id = a.agent_id AND b.t > a.t AND round(b.c * 1e6) >= round(a.c * 1e6) + 150000000 GROUP BY ALL), z AS (SELECT e.*, b.x AS ex, b.y AS ey, b.c - e.c AS length, sqrt((b.x - e.x) ** 2 + (b.y - e.y) ** 2) AS net FROM e JOIN c b ON b.series_id = e.series_id AND b.agent_id = e.agent_id AND b.t = e.et), o AS (SELECT z.*, CASE WHEN net >= 1e-9 THEN abs((p.x - z.x) * (ey - z.y) - (p.y - z.y) * (ex - z.x)) / net END AS off FROM z JOIN c p ON p.series_id = z.series_id AND p.agent_id = z.agent_id AND p.t BETWEEN z.t AND z.et) SELECT series_id, agent_id, t, round(length, 5) AS length, round(net, 5) AS net, round(least(net / length, 1), 6) AS efficiency, round(avg(off), 5) AS mean_dev, round(sqrt(avg(off * off)), 5) AS rms_dev FROM o GROUP BY series_id, agent_id, t, length, net""")
def path_linearity_windows(t):
    d = spatial.path_windows(_tracks(t), 150.0)
    return d.select("series_id", "agent_id", "t", *[F.round(c, 5).alias(c) for c in ("length", "net")], F.round("efficiency", 6).alias("efficiency"), *[F.round(c, 5).alias(c) for c in ("mean_dev", "rms_dev")])


@query(f"""{TRACK}, d AS (SELECT a.series_id, a.t, a.agent_id AS a, b.agent_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM tr a JOIN tr b ON a.series_id = b.series_id AND a.t = b.t AND a.agent_id < b.agent_id), c AS (SELECT *, (lag(d) OVER w - d) / (t - lag(t) OVER w) AS c FROM d WINDOW w AS (PARTITION BY series_id, a, b ORDER BY t)) SELECT series_id, a, b, t, round(avg(c) OVER (PARTITION BY series_id, a, b ORDER BY t RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS closing FROM c""")
def closing_at(t):
    return tidy(spatial.closing(_tracks(t), 3.0))


@query(f"""{TRACK}, v AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t)), a AS (SELECT series_id, t, agent_id, s - lag(s) OVER (PARTITION BY series_id, agent_id ORDER BY t) AS a FROM v), f AS (SELECT * FROM a WHERE a IS NOT NULL), j AS (SELECT u.series_id, u.agent_id AS a, v.agent_id AS b, u.t, u.a * v.a AS q FROM f u JOIN f v ON u.series_id = v.series_id AND u.t = v.t AND u.agent_id < v.agent_id) SELECT series_id, a, b, t, round(avg((q > 0)::INT) OVER w, 6) AS together, round(avg((q < 0)::INT) OVER w, 6) AS against FROM j WINDOW w AS (PARTITION BY series_id, a, b ORDER BY t RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def effort_phase_at(t):
    return tidy(spatial.effort_phase(_tracks(t), 3.0))


@query(f"""{TRACK}, k2 AS (SELECT series_id, agent_id, t, x, y, lag(x, 2) OVER w AS px, lag(y, 2) OVER w AS py, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, lead(x, 2) OVER w AS qx, lead(y, 2) OVER w AS qy, last_value(x) OVER u AS x1, last_value(y) OVER u AS y1 FROM tr WINDOW w AS (PARTITION BY series_id, agent_id ORDER BY t), u AS (PARTITION BY series_id, agent_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), d AS (SELECT *, x - coalesce(px, x0) AS ax, y - coalesce(py, y0) AS ay, coalesce(qx, x1) - x AS bx, coalesce(qy, y1) - y AS by_ FROM k2) SELECT series_id, agent_id, t, CASE WHEN ax * ax + ay * ay > 1e-18 THEN round(atan2(ay, ax), 6) END AS past, CASE WHEN bx * bx + by_ * by_ > 1e-18 THEN round(atan2(by_, bx), 6) END AS future FROM d""")
def bearings(t):
    d = _tracks(t)
    p = spatial.window_bearings(d, 2.0).select("series_id", "agent_id", "t", F.col("bearing").alias("past"))
    return tidy(p.join(spatial.window_bearings(d, 2.0, ahead=True).select("series_id", "agent_id", "t", F.col("bearing").alias("future")), ["series_id", "agent_id", "t"]))


@query(f"""{TRACK}, b AS (SELECT series_id, arg_min(t, (abs(t - 3.4), t)) AS t FROM (SELECT DISTINCT series_id, t FROM tr) GROUP BY series_id) SELECT tr.series_id, tr.t, agent_id, round(x, 6) AS x, round(y, 6) AS y FROM tr JOIN b ON b.series_id = tr.series_id AND b.t = tr.t""")
def closest_frame(t):
    return tidy(spatial.frame_closest(_tracks(t), 3.4).select("series_id", "t", "agent_id", "x", "y"))
