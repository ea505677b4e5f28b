"""Queries of the work log, of catalogue versions and of measures on a grid of time, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import catalog_versions, worklog
from tidewave.registry import query, tidy
from tidewave.streaming import cadence

_LOG = """WITH RECURSIVE c AS (SELECT 'q' || c_custkey AS id, CASE WHEN c_custkey >= 10 THEN 'q' || (c_custkey // 10) END AS parent, c_acctbal >= -900 AS fine FROM customer),
q(id) AS (SELECT id FROM c WHERE fine AND parent IS NULL UNION ALL SELECT c.id FROM q JOIN c ON c.parent = q.id WHERE fine),
a AS (SELECT 'a' || o_orderkey AS id, 'q' || o_custkey AS query_id, CASE o_orderstatus WHEN 'O' THEN 'revise' WHEN 'F' THEN 'spawn' ELSE 'session' END AS kind, 'q' || o_custkey IN (SELECT id FROM q) AS there FROM orders),
f AS (SELECT 'a' || l_orderkey AS id, CASE max(l_returnflag) WHEN 'R' THEN 'succeeded' WHEN 'N' THEN 'failed' ELSE 'odd' END AS outcome, count(*)::VARCHAR AS summary FROM lineitem GROUP BY l_orderkey),
t AS (SELECT a.id, query_id, kind, coalesce(CASE WHEN outcome <> 'odd' THEN outcome END, 'in_progress') AS outcome, CASE WHEN outcome <> 'odd' THEN summary END AS summary FROM a LEFT JOIN f USING (id) WHERE there)"""


def _log(t):
    """Customers as queries under one another, orders as their attempts, items as artifacts and what attempts came to."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")

    def rows(df, seq, action, id_, **more):
        cols = {"seq": seq.cast("long"), "at": F.timestamp_seconds(seq), "action": F.lit(action), "id": id_} | {c: more.get(c, none) for c in ("of", "parent", "agent", "state", "text", "sha256")}
        return df.select(*[v.cast("string").alias(c) if c not in ("seq", "at") else v.alias(c) for c, v in cols.items()])

    k = F.col("c_custkey")
    out = rows(t("customer"), k, "open_query", text("q", "c_custkey"), parent=F.when(k >= 10, F.concat(F.lit("q"), F.floor(k / 10).cast("string"))), text=F.when(F.col("c_acctbal") < -900, "").otherwise(F.col("c_name")))
    o = F.col("o_orderkey")
    out = out.union(rows(t("orders"), o + 10**9, "start_attempt", text("a", "o_orderkey"), of=text("q", "o_custkey"), agent=F.col("o_orderpriority"), state=F.when(F.col("o_orderstatus") == "O", "revise").when(F.col("o_orderstatus") == "F", "spawn")))
    g = t("lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.count("*").alias("n"))
    out = out.union(rows(g, F.col("l_orderkey") + 2 * 10**9, "finish_attempt", text("a", "l_orderkey"), state=F.when(F.col("flag") == "R", "succeeded").when(F.col("flag") == "N", "failed").otherwise("odd"), text=F.col("n")))
    i = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    return out.union(rows(i, 3 * 10**9 + F.col("l_orderkey") * 10 + F.col("l_linenumber"), "add_artifact", text("a", "l_orderkey"), state=F.lit("output"), text=text("part/", "part")))


@query(f"""{_LOG}, i AS (SELECT DISTINCT l_orderkey, l_linenumber, 'a' || l_orderkey IN (SELECT id FROM t) AS there, 'a' || l_orderkey IN (SELECT id FROM a) AS known FROM lineitem),
s AS (SELECT 'query' AS what, 'open' AS state FROM q UNION ALL SELECT 'attempt', outcome FROM t UNION ALL SELECT 'artifact', 'output' FROM i WHERE there UNION ALL SELECT 'refused', 'title is required' FROM c WHERE NOT fine UNION ALL SELECT 'refused', CASE WHEN parent IN (SELECT id FROM c WHERE fine) THEN 'what it refers to was refused' ELSE 'parent query not found' END FROM c WHERE fine AND id NOT IN (SELECT id FROM q)
UNION ALL SELECT 'refused', CASE WHEN query_id IN (SELECT id FROM c WHERE fine) THEN 'what it refers to was refused' ELSE 'query not found' END FROM a WHERE NOT there
UNION ALL SELECT 'refused', CASE WHEN outcome = 'odd' THEN 'unknown outcome' WHEN id IN (SELECT id FROM a) THEN 'what it refers to was refused' ELSE 'attempt not found' END FROM f WHERE outcome = 'odd' OR id NOT IN (SELECT id FROM t)
UNION ALL SELECT 'refused', CASE WHEN known THEN 'what it refers to was refused' ELSE 'attempt not found' END FROM i WHERE NOT there)
SELECT what, state, count(*) AS n FROM s GROUP BY 1, 2""")
def work_log_status(t):
    return worklog.status(worklog.judged(_log(t)).persist())


@query(f"{_LOG} SELECT id, query_id, kind, outcome, summary FROM t")
def work_log_attempts(t):
    return worklog.attempts(worklog.judged(_log(t)).persist()).select("id", "query_id", "kind", "outcome", "summary")


@query("""SELECT source_file, CASE WHEN o_orderstatus = 'F' THEN 'email' WHEN o_orderstatus = 'O' OR lower(o_orderpriority) LIKE '%high%' THEN 'polar' ELSE 'manual' END AS ingest_pipeline, coalesce(counts, true) AS counts_for_load, true AS is_primary, NULL::BIGINT AS ftp_history_id FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'email/' WHEN 'O' THEN 'x/polar/' ELSE 'z/' END || o_orderkey AS source_file, CASE WHEN o_totalprice < 1000 THEN false END AS counts FROM orders)""")
def catalog_migrated(t):
    status = F.col("o_orderstatus")
    a = t("orders").select(F.concat(F.when(status == "F", "email/").when(status == "O", "x/polar/").otherwise("z/"), F.col("o_orderkey").cast("string")).alias("source_file"), F.when(F.lower("o_orderpriority").contains("high"), "Polar Electro").alias("manufacturer"), F.when(F.col("o_totalprice") < 1000, F.lit(False)).alias("counts_for_load"))
    out = catalog_versions.upgraded(t("orders").sparkSession, {"activities": a}, 1)["activities"]
    return tidy(out.select("source_file", "ingest_pipeline", "counts_for_load", "is_primary", "ftp_history_id"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS sid, epoch_us(ts) AS us, value AS b, ceil(epoch_us(ts) / 86400e6)::BIGINT AS k FROM events WHERE value IS NOT NULL), x AS (SELECT sid, us, b, k + unnest(range(0, 7)) AS k FROM e), g AS (SELECT sid, k, count(*) AS n, avg(b) AS mean, stddev_pop(b) AS sd, list(b ORDER BY us, b) AS v FROM x GROUP BY 1, 2)
SELECT sid, epoch_ms(k * 86400000)::DATE AS day, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(v[len(v)], 6) AS last, round(list_reduce(v, lambda s, y: 0.2 * y + 0.8 * s), 6) AS smoothed FROM g""")
def cadence_measures(t):
    samples = t("events").select(F.col("user_id").cast("string").alias("sid"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("bpm"))
    d = cadence.measured(samples, 86_400, 7 * 86_400)
    return tidy(d.select("sid", F.col("end").cast("date").alias("day"), "n", "mean", "sd", "last", "smoothed"))
