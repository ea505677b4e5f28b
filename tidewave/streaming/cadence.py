"""Measures of each subject on a fixed grid of event time, over a lookback, as a stream and as a batch that give the same rows.

The stream keeps a subject's samples by the step of the grid they lie in, in whatever order they come, and a timer of event
time for each end of a window that holds one. When the watermark passes an end its window is measured in the order of
time, and what no later window needs is let go. Only what comes later than the watermark allows is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a step and of a lookback, and the weight of the newest sample.
STEP_S, LOOKBACK_S, ALPHA = 30, 180, 0.2
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "sid string, end timestamp, n long, mean double, sd double, last double, smoothed double"


def _step(at: Column, step_s: int) -> Column:
    """The number of the grid's step that a time lies in: a step ends with its end."""
    return F.ceil(F.unix_micros(at) / (step_s * 1_000_000)).cast("long")


def measured(samples: DataFrame, step_s: int = STEP_S, lookback_s: int = LOOKBACK_S, alpha: float = ALPHA) -> DataFrame:
    """(sid, end, n, mean, sd, last, smoothed) of samples (sid, at, bpm) in each window (end - lookback, end] that holds any.

    Ends are multiples of the step; the lookback is one too. sd is that of the population; smoothed goes through the window
    in the order of time, equal times by value, from its first sample on. Rows without a subject, time or value stay out.
    """
    most = lookback_s // step_s
    d = samples.where("sid is not null and at is not null and bpm is not null").select(F.col("sid").cast("string").alias("sid"), "at", F.col("bpm").cast("double").alias("bpm"), _step(F.col("at"), step_s).alias("_k"))
    d = d.withColumn("_k", F.explode(F.sequence("_k", F.col("_k") + most - 1)))
    g = d.groupBy("sid", "_k").agg(F.array_sort(F.collect_list(F.struct("at", "bpm"))).alias("_s"), F.count("bpm").alias("n"), F.avg("bpm").alias("mean"), F.stddev_pop("bpm").alias("sd"))
    v = F.transform("_s", lambda s: s["bpm"])
    smooth = F.aggregate(F.slice(v, 2, F.size(v)), F.get(v, F.lit(0)), lambda s, x: alpha * x + (1 - alpha) * s)
    return g.select("sid", F.timestamp_seconds(F.col("_k") * step_s).alias("end"), "n", "mean", "sd", F.element_at(v, -1).alias("last"), smooth.alias("smoothed"))


class _Cadence(StatefulProcessor):
    def __init__(self, step_s: int, most: int, alpha: float):
        self.step_s, self.most, self.alpha = step_s, most, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "k long", "at array<long>, bpm array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            pdf = pdf[pdf["us"] > passed]  # windows up to the watermark were measured
            for k, part in pdf.groupby("k"):
                have = self.steps.getValue((int(k),)) if self.steps.containsKey((int(k),)) else ([], [])
                self.steps.updateValue((int(k),), ([*have[0], *map(int, part["us"])], [*have[1], *map(float, part["bpm"])]))
                for end in range(int(k), int(k) + self.most):
                    self.handle.registerTimer(end * self.step_s * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.step_s
        samples = []
        for k in range(end - self.most + 1, end + 1):
            if self.steps.containsKey((k,)):
                at, bpm = self.steps.getValue((k,))
                samples += zip(at, bpm, strict=True)
        if self.steps.containsKey((end - self.most + 1,)):
            self.steps.removeKey((end - self.most + 1,))
        if not samples:
            return
        v = [b for _, b in sorted(samples)]
        smooth = v[0]
        for x in v[1:]:
            smooth = self.alpha * x + (1 - self.alpha) * smooth
        s = pd.Series(v)
        yield pd.DataFrame({"sid": [key[0]], "end": [pd.Timestamp(end * self.step_s, unit="s")], "n": [len(v)], "mean": [s.mean()], "sd": [s.std(ddof=0)], "last": [v[-1]], "smoothed": [smooth]})

    def close(self) -> None:
        pass


def stream(samples: DataFrame, late: str = "1 minute", step_s: int = STEP_S, lookback_s: int = LOOKBACK_S, alpha: float = ALPHA) -> DataFrame:
    """The rows of measured() of a stream of samples (sid, at, bpm), each once, when the watermark passes its end.

    late: how much later than the newest sample one may come. The state of a subject holds the samples of a lookback and of
    what may come late. The session must keep state in RocksDB, which is set here if it isn't.
    """
    spark, most = samples.sparkSession, lookback_s // step_s
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    d = samples.where("sid is not null and at is not null and bpm is not null").withWatermark("at", late)
    d = d.select(F.col("sid").cast("string").alias("sid"), "at", F.unix_micros("at").alias("us"), F.col("bpm").cast("double").alias("bpm"), _step(F.col("at"), step_s).alias("k"))
    return d.groupBy("sid").transformWithStateInPandas(_Cadence(step_s, most, alpha), OUT, "Append", "EventTime")
