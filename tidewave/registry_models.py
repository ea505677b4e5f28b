"""Queries of scores, probabilities, designs and draws, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import classification, probabilities
from tidewave.registry import WAVE, query, tidy, wave

_PAIR = ["l_quantity", "l_discount"]


@query("""WITH v AS (SELECT greatest(var_pop(l_quantity), var_pop(l_discount)) * 1e-9 AS e, count(*) AS n FROM lineitem), m AS (SELECT l_returnflag AS label, ln(count(*) / any_value(n)) AS prior, avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) + any_value(e) AS va, var_pop(l_discount) + any_value(e) AS vb FROM lineitem, v GROUP BY l_returnflag), li AS (SELECT *, row_number() OVER () AS rid FROM lineitem), s AS (SELECT rid, l_orderkey, l_linenumber, label, prior - 0.5 * (ln(2 * pi() * va) + (l_quantity - a) ** 2 / va) - 0.5 * (ln(2 * pi() * vb) + (l_discount - b) ** 2 / vb) AS j FROM li, m) SELECT l_orderkey, l_linenumber, label, round(j, 5) AS log_joint, round(exp(j - max(j) OVER w) / sum(exp(j)) OVER w * exp(max(j) OVER w), 5) AS p FROM s WINDOW w AS (PARTITION BY rid)""")
def nb_probabilities(t):
    d = t("lineitem")
    return tidy(probabilities.nb_proba(d, classification.gaussian_nb(d, _PAIR, "l_returnflag"), _PAIR, ["l_orderkey", "l_linenumber"]), 5)


_LDA = """WITH c AS (SELECT l_returnflag AS label, count(*)::DOUBLE AS n, avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) * count(*) AS saa, var_pop(l_discount) * count(*) AS sbb, covar_pop(l_quantity, l_discount) * count(*) AS sab FROM lineitem GROUP BY l_returnflag), p AS (SELECT sum(n) AS t, sum(saa) / (sum(n) - count(*)) AS aa, sum(sbb) / (sum(n) - count(*)) AS bb, sum(sab) / (sum(n) - count(*)) AS ab FROM c), i AS (SELECT *, aa * bb - ab * ab AS det FROM p), w AS (SELECT label, (a * bb - b * ab) / det AS wa, (b * aa - a * ab) / det AS wb, a, b, ln(n / t) AS prior FROM c, i), li AS (SELECT *, row_number() OVER () AS rid FROM lineitem), s AS (SELECT rid, l_orderkey, l_linenumber, l_returnflag, label, l_quantity * wa + l_discount * wb - 0.5 * (wa * a + wb * b) + prior AS s FROM li, w)"""


@query(f"""{_LDA} SELECT l_orderkey, l_linenumber, label, round(s, 5) AS score, round(exp(s) / sum(exp(s)) OVER (PARTITION BY rid), 5) AS p FROM s""")
def lda_probabilities(t):
    d = t("lineitem")
    return tidy(probabilities.lda_proba(d, classification.lda(d, _PAIR, "l_returnflag"), _PAIR, ["l_orderkey", "l_linenumber"]), 5)


@query(f"""{_LDA}, y AS (SELECT label, s, (l_returnflag = label)::INT AS y FROM s), g AS (SELECT label, round(s, 9) AS s, sum(y) AS p, sum(1 - y) AS n FROM y GROUP BY ALL), r AS (SELECT label, sum(p * (b + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) GROUP BY label) SELECT round(avg(auc), 5) AS auc FROM r""")
def auc_one_vs_rest(t):
    d = t("lineitem")
    m = classification.lda(d, _PAIR, "l_returnflag")
    scored = d.select("l_returnflag", *[F.round(probabilities.linear(_PAIR, w, b), 9).alias(f"s{k}") for k, (w, b) in enumerate(zip(m["w"], m["b"], strict=True))])
    return tidy(probabilities.roc_auc_ovr(scored, "l_returnflag", {c: f"s{k}" for k, c in enumerate(m["classes"])}), 5)


@query("""WITH d AS (SELECT q.vec_id AS query_id, t.vec_id AS t, t.label AS y, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, t) <= 5), v AS (SELECT query_id, y, sum(1 / (d + 1e-12)) AS v FROM b GROUP BY ALL) SELECT q.query_id, c.y AS label, round(coalesce(v, 0) / sum(coalesce(v, 0)) OVER (PARTITION BY q.query_id), 6) AS p FROM (SELECT DISTINCT query_id FROM b) q CROSS JOIN (SELECT DISTINCT label AS y FROM embeddings) c LEFT JOIN v ON v.query_id = q.query_id AND v.y = c.y""")
def knn_probabilities(t):
    e = t("embeddings")
    return tidy(probabilities.knn_proba(e, e.where("vec_id % 20 = 0"), 5, "embedding", "label", "vec_id", "vec_id", weighted=True, others=True))


@query("""WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) / 1000 AS mb, var_samp(l_quantity) AS aa, var_samp(l_extendedprice / 1000) AS bb, covar_samp(l_quantity, l_extendedprice / 1000) AS ab FROM lineitem), e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS v1, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS v2 FROM s), u AS (SELECT *, ab / sqrt(ab * ab + (v1 - aa) ** 2) AS x1, (v1 - aa) / sqrt(ab * ab + (v1 - aa) ** 2) AS y1, ab / sqrt(ab * ab + (v2 - aa) ** 2) AS x2, (v2 - aa) / sqrt(ab * ab + (v2 - aa) ** 2) AS y2 FROM e), g AS (SELECT *, CASE WHEN abs(x1) >= abs(y1) THEN sign(x1) ELSE sign(y1) END AS g1, CASE WHEN abs(x2) >= abs(y2) THEN sign(x2) ELSE sign(y2) END AS g2 FROM u) SELECT l_orderkey, l_linenumber, round(g1 * ((l_quantity - ma) * x1 + (l_extendedprice / 1000 - mb) * y1) / sqrt(v1), 4) AS pc_1, round(g2 * ((l_quantity - ma) * x2 + (l_extendedprice / 1000 - mb) * y2) / sqrt(v2), 4) AS pc_2 FROM lineitem, g""")
def pca_whitened(t):
    d = t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    cols = ["l_quantity", "price"]
    return tidy(probabilities.pca_scores(d, classification.pca(d, cols, 2), cols, ["l_orderkey", "l_linenumber"], whitened=True), 4)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax FROM lineitem""")
def scaler_round_trip(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax")])
    s = classification.standard_scaler(d, ["l_quantity", "l_tax"])
    return tidy(probabilities.unstandardize(classification.standardize(d, s), s))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 AND l_discount >= 0.05 THEN 0 WHEN l_tax < 0.02 THEN 1 END AS rule FROM lineitem), y AS (SELECT *, CASE rule WHEN 0 THEN 'bulk' WHEN 1 THEN 'light' ELSE 'plain' END AS predicted FROM r) SELECT l_orderkey, l_linenumber, predicted, rule::BIGINT AS rule, label, (label = predicted)::INT::DOUBLE AS p FROM y CROSS JOIN (SELECT unnest(['bulk', 'light', 'plain']) AS label)""")
def rule_hits(t):
    rules = [([("l_quantity", ">", 40.0), ("l_discount", ">=", 0.05)], "bulk"), ([("l_tax", "<", 0.02)], "light")]
    return tidy(probabilities.rule_hits(t("lineitem"), rules, "plain", ["bulk", "light", "plain"], ["l_orderkey", "l_linenumber"]))


@query(f"""{WAVE}, s AS (SELECT series_id, count(*) AS n, list(x ORDER BY x) AS v, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM wave GROUP BY series_id), q AS (SELECT *, (v[1 + round_even(0.75 * (n - 1), 0)::INT] - v[1 + round_even(0.25 * (n - 1), 0)::INT]) / 1.34 AS iqr FROM s), b AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE greatest(1.06 * coalesce(least(nullif(sd, 0), nullif(iqr, 0)), 0) * n ** -0.2, (hi - lo) * 0.001) END AS h0 FROM q), c AS (SELECT *, CASE WHEN h0 = 0 THEN 1.0 ELSE h0 END AS h, lo - 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS a, hi + 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS z FROM b), g AS (SELECT *, a + unnest(range(0, 20)) * (z - a) / 19 AS place FROM c) SELECT series_id, round(place, 6) AS "at", round(list_sum(list_transform(v, lambda y: exp(-0.5 * ((place - y) / h) ** 2))) / (n * h * sqrt(2 * pi())) * CASE WHEN hi > lo THEN n * (hi - lo) / 8 ELSE 1 END, 5) AS expected FROM g""")
def histogram_density(t):
    d = probabilities.hist_kde(wave(t), 8, 20)[1]
    return d.select("series_id", F.round("at", 6).alias("at"), F.round("expected", 5).alias("expected"))


@query("""SELECT o_orderkey, round(d, 6) AS t1, round(d * d, 6) AS t2, round(greatest(d - 0.25, 0), 6) AS h1, round(greatest(d - 0.5, 0), 6) AS h2, round(d - avg(d) OVER (), 6) AS centred FROM (SELECT o_orderkey, dayofyear(o_orderdate) / 365.0 AS d FROM orders)""")
def growth_design(t):
    d = t("orders").select("o_orderkey", (F.dayofyear("o_orderdate") / 365.0).alias("d"))
    c, _ = probabilities.centred_time(d.withColumn("centred", F.col("d")), "centred")
    return tidy(c.select("o_orderkey", *[v.alias(n) for n, v in probabilities.time_design(F.col("d"), 2, [0.25, 0.5]).items()], "centred"))


@query("""WITH u AS (SELECT c_custkey, list_transform(range(0, 5), lambda k: (('0x' || substr(md5('7:' || k || ':' || c_custkey), 1, 8))::BIGINT + 0.5) / 4294967296) AS u FROM customer) SELECT c_custkey, round(10 + 2 * sqrt(-2 * ln(u[1])) * cos(2 * pi() * u[2]), 6) AS normal, round(-(ln(u[1]) + ln(u[2])) * 3, 6) AS gamma, round((ln(u[1]) + ln(u[2])) / (ln(u[1]) + ln(u[2]) + ln(u[3]) + ln(u[4]) + ln(u[5])), 6) AS beta FROM u""")
def draws(t):
    k = F.col("c_custkey")
    return tidy(t("customer").select(k, probabilities.normal(k, 10.0, 2.0, 7).alias("normal"), probabilities.gamma(k, 2, 3.0, 7).alias("gamma"), probabilities.beta(k, 2, 3, 7).alias("beta")))


@query(f"""{WAVE}, d AS (SELECT series_id, i, x / 50 - 1 AS x, x / 50 - lag(x) OVER (PARTITION BY series_id ORDER BY i) / 50 AS v FROM wave) SELECT series_id, i, round(v, 6) AS dx, round(1.5 * (1 - x * x) * v - 4 * x + 0.5, 6) AS dv FROM d WHERE v IS NOT NULL""")
def van_der_pol(t):
    from tidewave.operators.series import over

    d = wave(t).withColumn("v", (F.col("x") - F.lag("x").over(over())) / 50).withColumn("x", F.col("x") / 50 - 1).where("v is not null")
    dx, dv = probabilities.van_der_pol(F.col("x"), F.col("v"), 1.5, 2.0, 0.5)
    return tidy(d.select("series_id", "i", dx.alias("dx"), dv.alias("dv")))


@query("SELECT l_returnflag AS label, count(*) AS n, round(avg((l_quantity <= 25)::INT), 6) AS accuracy FROM lineitem GROUP BY 1")
def label_shares(t):
    d = t("lineitem").withColumns({"hit": F.lit(1), "p": (F.col("l_quantity") <= 25).cast("int")})
    n = d.groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("hit") == F.col("p")).cast("double")).alias("accuracy"))
    return tidy(n)
