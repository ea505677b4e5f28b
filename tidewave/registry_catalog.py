"""Queries of the catalogue of activities, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import catalog, load
from tidewave.registry import _days, WAVE, query, tidy, wave

_METRICS = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY date) AS k FROM (SELECT c_mktsegment AS owner, o_orderdate::DATE AS date, sum(o_totalprice) / 1e6 AS total_tss FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)), r AS (SELECT *, total_tss / 42 AS ctl, total_tss / 7 AS atl FROM n WHERE k = 1 UNION ALL SELECT n.owner, n.date, n.total_tss, n.k, ctl + (n.total_tss - ctl) / 42, atl + (n.total_tss - atl) / 7 FROM r JOIN n ON n.owner = r.owner AND n.k = r.k + 1),
w AS (SELECT *, avg(total_tss) OVER (PARTITION BY owner ORDER BY date ROWS 6 PRECEDING) AS acute, avg(total_tss) OVER (PARTITION BY owner ORDER BY date ROWS 27 PRECEDING) AS chronic, avg(total_tss) OVER o AS m, stddev_pop(total_tss) OVER o AS s, sum(total_tss) OVER o AS t FROM r WINDOW o AS (PARTITION BY owner ORDER BY date ROWS UNBOUNDED PRECEDING)),
lm AS (SELECT owner, date, total_tss, CASE WHEN k >= 28 THEN acute END AS acute_load, CASE WHEN k >= 28 THEN chronic END AS chronic_load, CASE WHEN k >= 28 THEN acute / chronic END AS acwr, CASE WHEN k >= 28 THEN CASE WHEN acute / chronic < 0.8 THEN 'Low' WHEN acute / chronic <= 1.3 THEN 'Moderate' WHEN acute / chronic <= 1.5 THEN 'High' ELSE 'Very High' END END AS risk_level, ctl, atl, ctl - atl AS tsb, CASE WHEN k >= 2 THEN CASE WHEN s > 0 THEN m / s ELSE 1 END END AS monotony, CASE WHEN k >= 2 THEN t * CASE WHEN s > 0 THEN m / s ELSE 1 END END AS strain FROM w)"""


def _daily(t):
    return _days(t).select(F.col("series_id").alias("owner"), F.col("day").alias("date"), F.col("load").alias("total_tss"), F.lit(1).alias("ride_count"), F.lit("all").alias("primary_sport"))


def _rides(t, owner="c_mktsegment"):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col(owner).alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("ride_date"), F.concat(F.lit("ride"), F.col("o_orderkey").cast("string")).alias("source_file"), F.when(F.col("o_orderkey") % 3 > 0, F.round("o_totalprice", 2)).alias("tss"), F.lit(None).cast("double").alias("duration_s"), F.round(F.col("o_totalprice") / 100, 4).alias("np_w"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus") == "F").alias("is_primary"), (F.col("o_orderkey") % 2 == 0).alias("counts_for_load"))


@query(f"{_METRICS} SELECT owner, date, round(total_tss, 6) AS total_tss, round(acute_load, 6) AS acute_load, round(chronic_load, 6) AS chronic_load, round(acwr, 6) AS acwr, risk_level, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(tsb, 6) AS tsb, round(monotony, 5) AS monotony, round(strain, 4) AS strain FROM lm")
def load_metrics(t):
    m = catalog.load_metrics(_daily(t))
    return tidy(m.withColumns({"monotony": F.round("monotony", 5), "strain": F.round("strain", 4)}))


@query(f"{_METRICS} SELECT owner, date, round(total_tss, 6) AS total_tss, 1::BIGINT AS ride_count, 'all' AS primary_sport, round(acwr, 6) AS acwr, risk_level, round(monotony, 5) AS monotony, round(strain, 4) AS strain, round(acute_load, 6) AS acute_load, round(chronic_load, 6) AS chronic_load FROM lm UNION ALL SELECT event_type, ts::DATE, round(sum(value), 6), count(*), 'event', NULL, NULL, NULL, NULL, NULL, NULL FROM events GROUP BY 1, 2")
def daily_snapshots(t):
    d = _daily(t)
    e = t("events").groupBy(F.col("event_type").alias("owner"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("total_tss"), F.count("*").alias("ride_count")).withColumn("primary_sport", F.lit("event"))
    s = catalog.daily_snapshots(d.unionByName(e), catalog.load_metrics(d))
    return tidy(s.withColumns({"monotony": F.round("monotony", 5), "strain": F.round("strain", 4)}))


@query(f"{_METRICS} SELECT lm.owner, lm.date, round(total_tss, 6) AS total_tss, round(acwr, 6) AS acwr, risk_level, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(tsb, 6) AS tsb, round(o_totalprice / 100, 4) AS np_w, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice, 2) END AS ride_tss FROM lm LEFT JOIN (SELECT c_mktsegment, o_orderdate::DATE AS d, o_totalprice, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) a ON a.c_mktsegment = lm.owner AND a.d = lm.date")
def recent_load(t):
    d = _daily(t)
    return tidy(catalog.recent_load(d, catalog.load_metrics(d), _rides(t)))


@query("""WITH a AS (SELECT c_custkey AS owner, o_orderkey AS id, o_orderdate::DATE AS ride_date, 'ride' || o_orderkey AS source_file, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice, 2) END, 0) AS tss, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus = 'F' END, true) AS is_primary, o_orderkey % 2 = 0 AS counts_for_load FROM orders JOIN customer ON o_custkey = c_custkey) SELECT owner, id, tss, is_primary, counts_for_load, row_number() OVER (PARTITION BY owner ORDER BY ride_date, is_primary DESC, counts_for_load DESC, source_file) AS place FROM a""")
def ride_summaries(t):
    return tidy(catalog.ride_summaries(_rides(t, "c_custkey")).select("owner", "id", "tss", "is_primary", "counts_for_load", "place"))


_PATHS = """WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '/data/raw/polar/polar_' || o_orderkey || '.fit' WHEN 1 THEN '/data/raw/inbox/' || o_orderdate::DATE || '-ride.fit' WHEN 2 THEN 'C:\\raw\\manual\\' || replace((o_orderdate::DATE)::VARCHAR, '-', '_') || '.csv' WHEN 3 THEN '/data/raw/1234-01-01/run.csv' ELSE 'polar_.fit' END AS path, o_orderdate::DATE AS d FROM orders), q AS (SELECT *, CASE id % 5 WHEN 0 THEN 'polar_' || id || '.fit' WHEN 1 THEN d || '-ride.fit' WHEN 2 THEN replace(d::VARCHAR, '-', '_') || '.csv' WHEN 3 THEN 'run.csv' ELSE 'polar_.fit' END AS name FROM p)"""


@query(_PATHS + """ SELECT id, CASE id % 5 WHEN 0 THEN 'polar/' || name WHEN 1 THEN 'inbox/' || name WHEN 3 THEN '1234-01-01/run.csv' ELSE name END AS key, CASE id % 5 WHEN 1 THEN 'email' WHEN 0 THEN 'polar' WHEN 4 THEN 'polar' ELSE 'manual' END AS pipeline, CASE WHEN id % 5 = 0 THEN id::VARCHAR END AS external_id, strftime(d, '%Y-%m-%d') AS ride_date, epoch(d)::BIGINT + 3661 AS at FROM q""")
def path_facts(t):
    day = F.col("o_orderdate").cast("date")
    text, k = day.cast("string"), F.col("o_orderkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/data/raw/polar/polar_"), k.cast("string"), F.lit(".fit"))).when(k % 5 == 1, F.concat(F.lit("/data/raw/inbox/"), text, F.lit("-ride.fit"))).when(k % 5 == 2, F.concat(F.lit("C:\\raw\\manual\\"), F.regexp_replace(text, "-", "_"), F.lit(".csv"))).when(k % 5 == 3, "/data/raw/1234-01-01/run.csv").otherwise("polar_.fit")
    d = t("orders").select(k.alias("id"), path.alias("path"), day.alias("d"))
    p = catalog.pipeline(F.col("path"))
    return d.select("id", catalog.source_key(F.col("path"), "/data/raw").alias("key"), p.alias("pipeline"), catalog.external_id(F.col("path"), p).alias("external_id"), catalog.ride_date(F.col("path"), F.col("d")).alias("ride_date"), catalog.stamp_seconds(F.concat(F.col("d").cast("string"), F.lit("T01:01:01Z"))).alias("at"))


@query("""WITH s AS (SELECT user_id AS series_id, epoch_us(ts) / 1e6 AS t, value AS speed, (event_id % 3 = 0)::INT AS e FROM events), d AS (SELECT *, lead(t) OVER w - t AS a, t - lag(t) OVER w AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), c AS (SELECT series_id, count(*) AS n, sum(speed * coalesce(greatest(a, 0), greatest(coalesce(b, 0), 0))) AS x, sum(speed / 100 * coalesce(greatest(a, 0), 1)) AS y, sum(e) AS e FROM d GROUP BY series_id) SELECT series_id, round(CASE WHEN n >= 2 THEN x + 7.5 * e ELSE 0 END, 2) AS external_load, round(CASE WHEN n >= 2 THEN y + 7.5 * e ELSE 0 END, 2) AS relative_load FROM c""")
def external_loads(t):
    d = t("events").select(F.col("user_id").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("speed"), (F.col("event_id") % 3 == 0).cast("int").alias("events"))
    a, b = catalog.pace_load(d, 7.5), catalog.pace_load(d.withColumn("speed", F.col("speed") / 100), 7.5, relative=True).withColumnRenamed("external_load", "relative_load")
    return a.join(b, "series_id").select("series_id", F.round("external_load", 2).alias("external_load"), F.round("relative_load", 2).alias("relative_load"))


@query(f"""{WAVE} SELECT series_id, string_agg(CASE WHEN x >= 60 THEN '│' ELSE '·' END, '' ORDER BY i) AS marks, round(greatest(max(x), 0), 6) AS peak FROM wave GROUP BY series_id""")
def exceedance_markers(t):
    return tidy(catalog.markers(wave(t), 60.0))


@query("""WITH p AS (SELECT c_custkey, 1400.0 + c_custkey % 500 AS b FROM customer), q AS (SELECT *, round(b * 1.55) AS t FROM p) SELECT c_custkey, greatest(t - 600 * 0.75, b) AS eat_less, t - b + 600 * 0.25 AS move_less, greatest(t - 600 * 0.25, b) AS eat_more, t - b + 600 * 0.75 AS move_more, greatest(t - 300, b) AS eat_half, t - b + 300 AS move_half FROM q""")
def calorie_targets(t):
    b = 1400.0 + F.col("c_custkey") % 500
    d = t("customer").select("c_custkey", b.alias("b")).withColumn("t", load.tdee(F.col("b"), F.lit("moderate")))
    pairs = {n: catalog.calorie_targets(F.col("t"), F.col("b"), F.lit(600.0), s) for s, n in (("restriction", "less"), ("activity", "more"), ("balanced", "half"))}
    return tidy(d.select("c_custkey", *[c.alias(f"{what}_{n}") for n, both in pairs.items() for what, c in zip(("eat", "move"), both, strict=True)]))


@query("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS d, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'hash-' || o_orderkey END AS there FROM orders),
s AS (SELECT l_orderkey, l_quantity AS p, l_linenumber AS t, l_discount AS hr FROM lineitem),
h AS (SELECT o_orderstatus AS sport, date_trunc('month', o_orderdate)::DATE AS since, max(o_totalprice) / 1e3 AS w FROM orders GROUP BY 1, 2),
m AS (SELECT l_orderkey, avg(p) AS ap, max(p) AS mp, avg(p ** 4) ** 0.25 AS np, max(t)::DOUBLE AS last, greatest(max(t), 1)::DOUBLE AS dur, avg(hr) AS ahr FROM s GROUP BY l_orderkey),
j AS (SELECT f.*, coalesce(h.w, 200) AS ftp FROM f ASOF LEFT JOIN h ON f.o_orderstatus = h.sport AND f.d >= h.since),
r AS (SELECT * FROM j JOIN m ON l_orderkey = o_orderkey)
SELECT 'ride-' || o_orderkey || '.fit' AS source_file, 'c' || o_custkey AS owner, d AS ride_date, round(CASE WHEN there IS NULL THEN last END, 6) AS duration_s, round(CASE WHEN there IS NULL THEN ap END, 6) AS avg_power_w, round(CASE WHEN there IS NULL THEN np END, 6) AS np_w, round(CASE WHEN there IS NULL THEN dur * np * np / ftp / (ftp * 36) ELSE 1 END, 6) AS tss, round(CASE WHEN there IS NULL THEN ahr END, 6) AS avg_hr_bpm, CASE WHEN there IS NULL THEN 'manual' ELSE 'email' END AS ingest_pipeline FROM r
UNION ALL SELECT 'ride-' || o_orderkey || '.fit', 'c' || o_custkey, d, NULL, NULL, NULL, 1, NULL, 'email' FROM f WHERE there IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def catalog_ingest(t):
    new, _ = _ingested(t)
    return tidy(new.select("source_file", "owner", "ride_date", "duration_s", "avg_power_w", "np_w", "tss", "avg_hr_bpm", "ingest_pipeline"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'file_hash already present' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'no samples' END AS reason, CASE WHEN o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'skipped' ELSE 'inserted' END AS outcome, count(*) AS n FROM orders GROUP BY 1, 2""")
def catalog_outcomes(t):
    return _ingested(t)[1].groupBy("reason", "outcome").agg(F.count("*").alias("n"))


def _ingested(t):
    """Orders as files whose samples are their items; those of status F are in the catalogue already."""
    k = F.col("o_orderkey").cast("string")
    o = t("orders").withColumns({"owner": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "name": F.concat(F.lit("ride-"), k, F.lit(".fit")), "h": F.concat(F.lit("hash-"), k), "d": F.col("o_orderdate").cast("date")})
    none = F.lit(None).cast("string")
    files = o.select("owner", F.concat(F.lit("/data/raw/"), "name").alias("path"), F.lit(1).cast("long").alias("bytes"), F.col("h").alias("file_hash"), none.alias("manufacturer"), none.alias("product"), F.col("o_orderstatus").alias("sport"), F.col("d").cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("modified"), none.alias("error"))
    samples = t("lineitem").select(F.concat(F.lit("/data/raw/ride-"), F.col("l_orderkey").cast("string"), F.lit(".fit")).alias("path"), F.col("l_linenumber").cast("double").alias("t_s"), F.col("l_quantity").cast("double").alias("power_w"), F.col("l_discount").cast("double").alias("heart_rate_bpm"), F.lit(None).cast("double").alias("cadence"), F.lit(None).cast("double").alias("speed_mps"))
    have = {"owner": F.col("owner"), "source_file": F.col("name"), "file_hash": F.col("h"), "ride_date": F.col("d"), "tss": F.lit(1.0), "ingest_pipeline": F.lit("email")}
    there = o.where("o_orderstatus = 'F'").select(*[have.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in catalog.ACTIVITIES.split(", ")])
    month = F.date_trunc("month", "d").cast("date")
    history = o.groupBy(F.col("o_orderstatus").alias("sport"), month.alias("since")).agg((F.max("o_totalprice") / 1e3).alias("ftp_w")).withColumn("until", F.lit(None).cast("date"))
    return catalog.ingest(files, samples, there, history, 200.0, "/data/raw")
