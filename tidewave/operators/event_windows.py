"""Windows of detected events that end on a grid: scores of their intervals, repair, measures, and coupling of two streams.

Every event is sent to the windows it lies in, of which there are a bounded number, so that series of any length are dealt
to many tasks; within a window scores and repairs are window functions. Kernels see one window of intervals at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.operators import dynamics
from tidewave.operators.biosignals import MEAN_MIN, POINT_MIN, STEP_S, WINDOW_S, peer_fit
from tidewave.operators.series import ID

#: Template length and share of a deviation of the entropies, and what times may differ by.
ENTROPY_M, ENTROPY_R, BREADTH = 2, 0.2, 1e-9
KEY = [ID, "end"]


def grid(first: Column, last: Column, step: float = STEP_S) -> tuple[Column, Column]:
    """(greatest number, end of a number as a function of k): ends from WINDOW_S after first on, up to last."""
    return F.floor((last - first - WINDOW_S + BREADTH) / step).cast("long"), lambda k: first + WINDOW_S + k * step


def windows(events: DataFrame, bounds: DataFrame, step: float = STEP_S) -> DataFrame:
    """(series_id, end, t, prominence): the events (series_id, t, prominence) of each window of bounds (series_id, first, last).

    A window holds the events from WINDOW_S before its end to its end, both with them.
    """
    d = events.join(bounds, ID)
    most, at = grid(F.col("first"), F.col("last"), step)
    lo = F.greatest(F.ceil((F.col("t") - F.col("first") - WINDOW_S - BREADTH) / step).cast("long"), F.lit(0))
    hi = F.least(F.floor((F.col("t") - F.col("first") + BREADTH) / step).cast("long"), most)
    d = d.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    return d.select(ID, at(F.col("_k")).alias("end"), "t", "prominence")


def ends(bounds: DataFrame, step: float = STEP_S) -> DataFrame:
    """(series_id, end) of all windows of the grid, whether they hold events or not."""
    most, at = grid(F.col("first"), F.col("last"), step)
    return bounds.where(most >= 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), most))).select(ID, at(F.col("_k")).alias("end"))


def bounds(events: DataFrame) -> DataFrame:
    """(series_id, first, last) times of each series."""
    return events.groupBy(ID).agg(F.min("t").alias("first"), F.max("t").alias("last"))


def scorable(events: DataFrame) -> DataFrame:
    """The events of the series that can be scored: four or more, finite, no two at one time."""
    bad = F.col("t").isNull() | F.col("prominence").isNull() | F.isnan("t") | F.isnan("prominence") | (F.abs("t") == float("inf")) | (F.abs("prominence") == float("inf"))
    g = events.groupBy(ID).agg(F.max(F.coalesce(bad, F.lit(True))).alias("_bad"), F.count(F.lit(1)).alias("_n"), F.count_distinct("t").alias("_d"))
    return events.join(g.where("not _bad and _n >= 4 and _n = _d").select(ID), ID, "left_semi")


def scores(windowed: DataFrame) -> DataFrame:
    """(series_id, end, t, interval, prominence, peer_fit, detector_fit, probability, span) of the intervals of each window.

    Each event but a window's first closes an interval. An interval fits as it lies among the window's others, an event as its
    prominence lies among those of all events of the window; the probability is the lesser. Windows of fewer than four
    events have no rows.
    """
    own = Window.partitionBy(*KEY)
    d = windowed.withColumns({"_n": F.count(F.lit(1)).over(own), "span": F.max("t").over(own) - F.min("t").over(own)}).where("_n >= 4")
    d = d.withColumn("_w", F.struct(*KEY))
    d = peer_fit(d, "prominence", "_w", "detector_fit")
    d = d.withColumn("interval", F.col("t") - F.lag("t").over(own.orderBy("t"))).where("interval is not null")
    d = peer_fit(d, "interval", "_w", "peer_fit")
    return d.select(*KEY, "t", "interval", "prominence", "peer_fit", "detector_fit", F.least("peer_fit", "detector_fit").alias("probability"), "span")


def repaired(scored: DataFrame) -> DataFrame:
    """scored with value and mean_probability, of the windows that are admitted.

    value: the interval, or where its probability is under POINT_MIN what lies on the line over time between the next kept
    ones. Admitted: events WINDOW_S or more apart, a mean probability over MEAN_MIN, and no interval to repair at either end.
    """
    own = Window.partitionBy(*KEY)
    good = F.col("probability") >= POINT_MIN
    kept = F.when(good, F.struct("t", F.col("interval").alias("v")))
    back = F.last(kept, True).over(own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(kept, True).over(own.orderBy("t").rowsBetween(0, Window.unboundedFollowing))
    d = scored.withColumns({"mean_probability": F.avg("probability").over(own), "_a": back, "_b": ahead})
    d = d.withColumn("_open", F.max(F.col("_a").isNull() | F.col("_b").isNull()).over(own))
    line = F.col("_a.v") + (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t")) * (F.col("_b.v") - F.col("_a.v"))
    d = d.where((F.col("span") >= WINDOW_S) & (F.col("mean_probability") > MEAN_MIN) & ~F.col("_open"))
    return d.withColumn("value", F.when(good, F.col("interval")).otherwise(line)).drop("_a", "_b", "_open")


def _values(d: DataFrame, name: str) -> DataFrame:
    """(series_id, end, name, mean_probability): the repaired intervals of each window in order; a window's worth is in one row."""
    g = d.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_s"), F.first("mean_probability").alias("mean_probability"))
    return g.select(*KEY, F.transform("_s", lambda s: s["value"]).alias(name), "mean_probability")


def rolling_measures(events: DataFrame, step: float = STEP_S) -> DataFrame:
    """(series_id, end, n, rmssd, cv, sample_entropy, mean_probability, n_step, mean_interval, std_interval, mean_step,
    std_step) of each window of the grid of each series (series_id, t, prominence) that can be scored.

    The first measures are of the repaired intervals, null where the window isn't admitted; those from n_step on of the
    measured intervals and their probabilities in the last step, with null deviations for fewer than two.
    """
    events = scorable(events.select(ID, "t", "prominence"))
    span = bounds(events)
    scored = scores(windows(events, span, step))
    values = _values(repaired(scored), "values")

    def entropy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sample_entropy=[dynamics.sample_entropy(x := np.asarray(v, float), ENTROPY_M, ENTROPY_R * x.std()) for v in pdf["values"]])

    m = values.mapInPandas(entropy, T.StructType([*values.schema.fields, T.StructField("sample_entropy", T.DoubleType())]))
    size = F.size("values")
    total = lambda f: F.aggregate(f, F.lit(0.0), lambda s, v: s + v)
    mean = total(F.col("values")) / size
    away = F.sqrt(total(F.transform("values", lambda v: (v - mean) * (v - mean))) / size)
    steps = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.get("values", i) - F.get("values", i - 1))
    m = m.select(*KEY, size.alias("n"), F.when(size >= 3, F.sqrt(total(F.transform(steps, lambda v: v * v)) / (size - 1))).alias("rmssd"), (away / F.abs(mean)).alias("cv"), "sample_entropy", "mean_probability")
    late = scored.where((F.col("t") > F.col("end") - step + BREADTH) & (F.col("t") <= F.col("end") + BREADTH))
    sd = lambda c: F.when(F.count(c) >= 2, F.stddev_pop(c))
    late = late.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_step"), F.avg("interval").alias("mean_interval"), sd("interval").alias("std_interval"), F.avg("probability").alias("mean_step"), sd("probability").alias("std_step"))
    return ends(span, step).join(m, KEY, "left").join(late, KEY, "left")


def trim_to_same_end(left: Column, right: Column) -> tuple[Column, Column]:
    """Two arrays without the oldest values of the longer one."""
    n = F.least(F.size(left), F.size(right))
    cut = lambda a: F.when(n > 0, F.slice(a, F.size(a) - n + 1, n)).otherwise(F.slice(a, 1, 0))
    return cut(left), cut(right)


COUPLING = "n_intervals long, cross_sample_entropy double, rr double, det double, lam double, mean_diag double, diag_entropy double"


def coupling(x: np.ndarray, y: np.ndarray) -> dict:
    """Cross-sample entropy and cross recurrence of two windows of as many intervals, within a share of their common deviation."""
    r = ENTROPY_R * np.r_[x, y].std()
    a, b = (dynamics.embed(v, ENTROPY_M, 1) for v in (x, y))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    q = dynamics.rqa(d <= r)
    return {"n_intervals": len(x), "cross_sample_entropy": dynamics.cross_sample_entropy(x, y, ENTROPY_M, r), "rr": q["rr"], "det": q["det"], "lam": q["lam"], "mean_diag": q["lmean"], "diag_entropy": q["entropy"]}


def rolling_joint_coupling(left: DataFrame, right: DataFrame, step: float = STEP_S) -> DataFrame:
    """(series_id, end, n_intervals, cross_sample_entropy, rr, det, lam, mean_diag, diag_entropy) of two event streams of each
    series, on a common grid from WINDOW_S after the later start to the earlier end.

    left and right: (series_id, t, prominence). Both windows of an end are repaired by themselves and trimmed to as many of
    their last intervals; the measures are null where one isn't admitted or fewer than two are left. A series that one side
    lacks or that can't be scored on one side has no rows.
    """
    left, right = (scorable(e.select(ID, "t", "prominence")) for e in (left, right))
    a, b = bounds(left), bounds(right).withColumnsRenamed({"first": "_f", "last": "_l"})
    span = a.join(b, ID).select(ID, F.greatest("first", "_f").alias("first"), F.least("last", "_l").alias("last"))
    l, r = (_values(repaired(scores(windows(e, span, step))), n).select(*KEY, n) for e, n in ((left, "x"), (right, "y")))
    x, y = trim_to_same_end(F.col("x"), F.col("y"))
    both = l.join(r, KEY).select(*KEY, x.alias("x"), y.alias("y")).where(F.size("x") >= 2)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [coupling(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(pdf.x, pdf.y, strict=True)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COUPLING.split(", ")], index=pdf.index)
            yield pd.concat([pdf[KEY], out], axis=1)

    kinds = dict(both.dtypes)
    return ends(span, step).join(both.mapInPandas(measure, f"{ID} {kinds[ID]}, end double, {COUPLING}"), KEY, "left")
