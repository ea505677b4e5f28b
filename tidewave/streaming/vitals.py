"""Vitals as a stream: status of each sample, last samples per subject, windows and stateful smoothing.

The same expressions serve batch frames; state is kept per subject, and what is late beyond the watermark is left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewave.sources.readers import vitals

#: Heart rates a minute and oxygen in percent beyond which a sample is warned of or critical.
HR_WARN, HR_CRITICAL, HR_LOW, SPO2_WARN, SPO2_CRITICAL = 100.0, 120.0, 50.0, 94.0, 90.0


def heart_rate(bpm: Column, bpm_avg: Column) -> Column:
    return F.coalesce(bpm, bpm_avg)


def status(hr: Column, spo2: Column) -> Column:
    """Critical, Warning or Normal; a missing value says nothing, and oxygen never lowers what the rate says."""
    critical = F.coalesce(hr > HR_CRITICAL, F.lit(False)) | F.coalesce(spo2 < SPO2_CRITICAL, F.lit(False))
    warning = F.coalesce((hr > HR_WARN) | (hr < HR_LOW), F.lit(False)) | F.coalesce(spo2 < SPO2_WARN, F.lit(False))
    return F.when(critical, "Critical").when(warning, "Warning").otherwise("Normal")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of samples from files of JSON lines, with event time from timestamp, else from ts in milliseconds."""
    s = spark.readStream.text(path).select(vitals(F.col("value")).alias("s")).select("s.*")
    return s.withColumn("at", F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_millis("ts")))


def with_status(samples: DataFrame) -> DataFrame:
    return samples.withColumn("status", status(heart_rate(F.col("bpm"), F.col("bpm_avg")), F.col("spo2")))


def windowed(samples: DataFrame, length: str = "3 minutes", step: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(sid, start, end, n, bpm, spo2) of sliding windows of event time."""
    g = samples.withWatermark("at", late).groupBy("sid", F.window("at", length, step)).agg(F.count(F.lit(1)).alias("n"), F.avg("bpm").alias("bpm"), F.avg("spo2").alias("spo2"))
    return g.select("sid", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "bpm", "spo2")


def ring(samples: DataFrame, capacity: int = 300) -> DataFrame:
    """(sid, ts, bpm) of the last samples of each subject after each batch; the state holds no more than capacity."""

    def run(key, batches, state: GroupState):
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf.ts.tolist(), pdf.bpm.tolist(), strict=True))
        kept = sorted(kept, key=lambda r: r[0])[-capacity:]
        state.update(([r[0] for r in kept], [r[1] for r in kept]))
        yield pd.DataFrame({"sid": key[0], "ts": [r[0] for r in kept], "bpm": [r[1] for r in kept]})

    return samples.select("sid", "ts", "bpm").groupBy("sid").applyInPandasWithState(run, "sid string, ts long, bpm double", "ts array<long>, bpm array<double>", "update", GroupStateTimeout.NoTimeout)


def smoothed(samples: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(sid, ts, bpm, ema): exponentially weighted mean in the order of ts within a batch, seeded by the first sample."""

    def run(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("ts")
        out = []
        for v in pdf.bpm:
            if v == v:
                last = v if last is None else alpha * v + (1 - alpha) * last
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pdf.assign(sid=key[0], ema=out)[["sid", "ts", "bpm", "ema"]]

    return samples.select("sid", "ts", "bpm").groupBy("sid").applyInPandasWithState(run, "sid string, ts long, bpm double, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def simulate(spark: SparkSession, rows_per_second: int = 20) -> DataFrame:
    """A stream of made-up samples from the rate source."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return r.select(F.concat(F.lit("s"), (F.col("value") % 4).cast("string")).alias("sid"), F.col("timestamp").alias("at"), (F.col("value") * 50).alias("ts"), (72 + 8 * F.sin(F.col("value") / 15.0)).alias("bpm"), (97 + F.sin(F.col("value") / 40.0)).alias("spo2"))
