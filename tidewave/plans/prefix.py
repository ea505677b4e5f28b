"""Running sums over a whole frame that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order: str, columns: list[str], buckets: int = 200, before: bool = False) -> DataFrame:
    """df with run_<c> for each column: its sum over all rows up to and with those of the same order, or before them.

    order is numeric, without nulls, one row for each value. Rows are cut into ranges at approximate quantiles; the ranges'
    totals, at most buckets + 1 rows, meet in one task and are sent back, and each range is summed up by itself.
    """
    bounds = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.002)))
    at = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    d = df.withColumn("_b", at)
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    totals = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_a_{c}") for c in columns])
    own = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = d.join(F.broadcast(totals), "_b")
    return out.select(*df.columns, *[(F.col(f"_a_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"run_{c}") for c in columns])
