"""Exact percentiles by group without a group's values in one place.

A first pass sketches each group; from the sketch's error bound follow two values between which the wanted rank must lie. A
second pass counts what is below them and gathers the values in between, each with its count, which is a small share of a
large group. Rank and value are exact, whatever the sketch said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch is wrong by at most n / ACCURACY ranks; groups of no more rows are taken whole. MARGIN is on top of that.
ACCURACY, MARGIN = 10_000, 4


def percentiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each name of shares: that share's (0 to 1) percentile of x, by linear interpolation.

    One row for each group that has an x that is not null; NaN counts as greater than all numbers. Ties count as often as
    they occur. At most 2 * MARGIN / ACCURACY of a group's different values meet in one sorted window, for each share.
    """
    d = df.select(*by, F.col(x).cast("double").alias("_x")).where("_x is not null")
    names, eps = list(shares), MARGIN / ACCURACY
    edges = [min(max(p + s * eps, 0.0), 1.0) for p in shares.values() for s in (-1, 1)]
    g = d.groupBy(*by).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", edges, ACCURACY).alias("_q"))
    small = F.col("_n") <= ACCURACY

    def target(i: int, p: float):
        r = F.lit(p) * (F.col("_n") - 1)
        low = F.when(small | F.lit(p <= eps), F.col("_lo")).otherwise(F.col("_q")[2 * i])
        high = F.when(small | F.lit(p >= 1 - eps), F.col("_hi")).otherwise(F.col("_q")[2 * i + 1])
        return F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"), r.alias("r"), F.floor(r).alias("k0"), F.ceil(r).alias("k1"))

    g = g.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.array(*[target(i, p) for i, p in enumerate(shares.values())]).alias("_t"))
    same = F.lit(True)
    for c in by:
        same = same & d[c].eqNullSafe(g[f"_g_{c}"])
    banded = d.join(g, same).select(*by, "_x", F.explode("_t").alias("_t")).where("_x <= _t.high")
    counted = banded.groupBy(*by, "_t", F.when(F.col("_x") >= F.col("_t.low"), F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # what is below the band stands first, without a value
    w = Window.partitionBy(*by, "_t.i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_c", F.sum("_c").over(w))
    missed = F.max(F.col("_v").isNull() & (F.col("_c") > F.col("_t.k0")))
    at = counted.groupBy(*by, "_t").agg(missed.alias("_m"), *[F.min(F.when(F.col("_c") > F.col(f"_t.k{k}"), F.col("_v"))).alias(f"_v{k}") for k in (0, 1)])
    r, k0, k1 = (F.col(f"_t.{c}") for c in ("r", "k0", "k1"))
    value = F.when(F.col("_m") | F.col("_v1").isNull(), F.raise_error(F.lit("a rank lies outside the band of its sketch")).cast("double"))
    value = value.when((k0 == k1) | (F.col("_v0") == F.col("_v1")), F.col("_v0")).otherwise((k1 - r) * F.col("_v0") + (r - k0) * F.col("_v1"))
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("_t.i") == i, value)).alias(n) for i, n in enumerate(names)])
