"""The stream of measures on a grid against the batch, however the samples are split, and the batch against a plain reading."""

import datetime
import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.streaming import cadence

def put(spark, rows, folder, k):
    """Rows as the k-th file, by the time of its change too."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    for f in glob.glob(f"{folder}/in/part={k}/*.parquet"):
        os.utime(f, (1e9 + 60 * k,) * 2)


T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "sid string, at timestamp, bpm double"


def made(seed):
    r = random.Random(seed)
    rows = [(sid, T0 + datetime.timedelta(seconds=r.choice([30 * r.randrange(30), 900 * r.random()])), float(r.randrange(50, 120))) for sid in "ab" for _ in range(60)]
    rows += [("c", T0 + datetime.timedelta(seconds=5000), 60.0), ("a", T0, None), (None, T0, 1.0), ("b", T0 + datetime.timedelta(seconds=60), 70.0), ("b", T0 + datetime.timedelta(seconds=60), 71.0)]
    return sorted(rows, key=lambda x: x[1])


def batch(spark, rows):
    return {(r.sid, r.end): r[2:] for r in cadence.measured(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_batch_equals_a_plain_reading(spark):
    rows = made(1)
    want = {}
    for sid in "abc":
        mine = sorted((t.timestamp(), b) for s, t, b in rows if s == sid and b is not None)
        for end in range(int(T0.timestamp()) - 300, int(T0.timestamp()) + 6000, 30):
            v = [b for t, b in mine if end - 180 < t <= end]
            if v:
                e = v[0]
                for x in v[1:]:
                    e = 0.2 * x + 0.8 * e
                want[sid, end] = (len(v), np.mean(v), np.std(v), v[-1], e)
    got = {(r.sid, r.e): (r.n, r["mean"], r.sd, r["last"], r.smoothed) for r in cadence.measured(spark.createDataFrame(rows, SCHEMA)).withColumn("e", F.unix_seconds("end")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert cadence.measured(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch_in_any_split(spark, tmp_path, parts):
    rows = made(2)
    r = random.Random(parts)
    # up to two minutes of disorder, within what the watermark allows
    rows.sort(key=lambda x: x[1] + datetime.timedelta(seconds=r.uniform(0, 120)))
    cuts = [0, *sorted(r.sample(range(1, len(rows)), parts - 1)), len(rows)]
    for k in range(parts):
        put(spark, rows[cuts[k] : cuts[k + 1]], tmp_path, k)
    # a last sample far ahead moves the watermark over all others
    put(spark, [("z", T0 + datetime.timedelta(days=9), 1.0)], tmp_path, parts)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = cadence.stream(source, "3 minutes").writeStream.format("memory").queryName(f"cadence_{parts}").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = [(x.sid, x.end, x[2:]) for x in spark.table(f"cadence_{parts}").collect() if x.sid != "z"]
    want = batch(spark, rows)
    assert len(got) == len(want) == len({x[:2] for x in got})
    assert all(v == pytest.approx(want[sid, end]) for sid, end, v in got)


def test_only_what_is_too_late_is_left_out(spark, tmp_path):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    for k, rows in enumerate([[("a", at(10), 60.0)], [("a", at(400), 61.0)], [("a", at(330), 62.0), ("a", at(20), 99.0)], [("z", at(9999), 1.0)]]):
        put(spark, rows, tmp_path, k)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = cadence.stream(source, "100 seconds").writeStream.format("memory").queryName("cadence_late").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = {(x.sid, x.end): x[2:] for x in spark.table("cadence_late").collect() if x.sid == "a"}
    assert got == batch(spark, [("a", at(10), 60.0), ("a", at(400), 61.0), ("a", at(330), 62.0)])
