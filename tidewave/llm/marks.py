"""A bit map of fixed size over the hashes of a key: it says of each key that it may be there, and never wrongly no.

Its size doesn't grow with the data, so it may be sent to every task. Where it fills up it lets more rows pass, and the
join that follows stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import fresh

BITS = 24


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def marks(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bit map of the only column of keys.

    At most 2 ** bits / 62 rows come to the driver (4 MB at 24 bits), from partial maps of each task.
    """
    key = keys.columns[0]
    at = keys.select(_place(key, bits).alias("p"))
    got = at.groupBy(F.expr("p div 62").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 62 as int)))").alias("b")).toArrow()
    out = np.zeros((1 << bits) // 62 + 1, np.int64)
    out[np.asarray(got.column("w"))] = np.asarray(got.column("b"))
    return out


def marked(df: DataFrame, key: str, bitmap: np.ndarray, bits: int = BITS, then=None, schema=None) -> DataFrame:
    """The rows of df whose key may be in the map, all columns kept.

    then: a function of their batches that gives batches of the schema; it runs in the same worker, and what it gives comes
    back in their place.
    """
    b = df.sparkSession.sparkContext.broadcast(bitmap)

    def kept(batches):
        for batch in batches:
            p = np.asarray(batch.column(batch.num_columns - 1))
            ok = (b.value[p // 62] >> (p % 62)) & 1 == 1
            if ok.any():
                yield batch.select(batch.schema.names[:-1]).filter(pa.array(ok))

    def run(batches):
        return then(kept(batches)) if then else kept(batches)

    return df.select("*", _place(key, bits).alias(fresh("_place", df))).mapInArrow(run, schema if then else df.schema)
