"""Joins on keys that very many rows may share, by salting the frequent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of over 1 / MOST of the counted rows is frequent, so there are at most MOST of them, and their hashes may go to all tasks.
MOST = 1000
#: Parts that a frequent key's rows are dealt to.
WAYS = 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], scatter: Column, how: str = "inner") -> DataFrame:
    """left joined with right on keys, without right's n.

    right has one row a key and in n how many rows of left have it. Rows of left with a frequent key are dealt to WAYS parts
    by a hash of scatter, an expression that tells them apart; right's row of such a key is sent to each part. Columns of
    both other than the keys must have different names.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = right.where(F.col("n") * MOST > total).select(F.xxhash64(*keys).alias("_hot")).distinct()
    salt = F.pmod(F.xxhash64(scatter), F.lit(WAYS)).cast("int")
    here = left.join(F.broadcast(hot), F.xxhash64(*[left[k] for k in keys]) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0)).drop("_hot")
    there = right.join(F.broadcast(hot), F.xxhash64(*[right[k] for k in keys]) == F.col("_hot"), "left").drop("n")
    there = there.withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return here.join(there, [*keys, "_salt"], how).drop("_salt")
