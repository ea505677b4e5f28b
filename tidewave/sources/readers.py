"""Readers and writers: numeric tables, interval files, activities, trajectories and JSON lines. All go through Spark's sources."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a time stamp of 4 bytes and an interval of 2, little-endian.
IBI = "<IH"

VITALS = T.StructType([T.StructField(n, t, True) for n, t in (("red", T.LongType()), ("ir", T.LongType()), ("bpm", T.DoubleType()), ("heart_rate", T.DoubleType()), ("bpm_avg", T.DoubleType()), ("spo2", T.DoubleType()), ("resp", T.DoubleType()), ("respiration", T.DoubleType()), ("ts", T.LongType()), ("sid", T.StringType()), ("patient_id", T.StringType()), ("source", T.StringType()), ("timestamp", T.StringType()))])

ACTIVITY = "activity_id string, t_s double, power_w double, heart_rate_bpm double, speed_mps double, cadence double, altitude_m double"


def numeric_table(spark: SparkSession, path: str, sep: str | None = ",", names: list[str] | None = None) -> DataFrame:
    """The numeric columns of a delimited table; sep None splits at white space.

    With a header, a column with a cell that is neither empty nor a number is left out whole, and empty cells are 0. With
    explicit names, any such cell is an error.
    """
    if sep is None:
        lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where("size(c) > 0 and c[0] <> ''")
        width = len(names) if names else lines.first().c.__len__()
        raw = lines.select(*[F.get("c", F.lit(i)).alias(names[i] if names else f"_c{i}") for i in range(width)])
    else:
        raw = spark.read.option("header", names is None).option("sep", sep).csv(path)
        raw = raw.toDF(*names) if names else raw
    if names:
        return raw.select(*[F.col(c).cast("double") for c in names])
    number = [F.bool_and(F.coalesce(F.trim(c) == "", F.lit(True)) | F.col(c).try_cast("double").isNotNull()).alias(c) for c in raw.columns]
    good = raw.agg(*number).first().asDict()
    return raw.select(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in raw.columns if good[c] is not False])


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def numeric_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columns as doubles; what is no number becomes 0."""
    raw = spark.read.parquet(path)
    numeric = (T.NumericType, T.BooleanType)
    return raw.select(*[F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)).alias(f.name) if isinstance(f.dataType, numeric) else F.lit(0.0).alias(f.name) for f in raw.schema])


def ibi(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, timestamp, rr_ms) of files of 6-byte records, little-endian; what is left at a file's end is no record."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(struct.iter_unpack(IBI, content[: len(content) // 6 * 6]))
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(rows), pa.string()), "k": pa.array(range(len(rows)), pa.int64()), "timestamp": pa.array([r[0] for r in rows], pa.int64()), "rr_ms": pa.array([r[1] for r in rows], pa.int32())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, k long, timestamp long, rr_ms int")


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Activity samples of CSV files with any of the known columns; activity_id is the file's name."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    alias = {"t_s": ("t_s", "time", "t"), "power_w": ("power_w", "power", "watts"), "heart_rate_bpm": ("heart_rate_bpm", "heart_rate", "hr"), "speed_mps": ("speed_mps", "speed"), "cadence": ("cadence",), "altitude_m": ("altitude_m", "altitude", "elevation")}
    pick = lambda names: next((F.col(have[n]).try_cast("double") for n in names if n in have), F.lit(None).cast("double"))
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("activity_id"), *[pick(n).alias(c) for c, n in alias.items()])


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, t, agent_id, x, y) of CSV files with columns time, agent_id, x and y in any case; others are passed over."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): F.col(c) for c in raw.columns}
    return raw.select(F.input_file_name().alias("series_id"), have["time"].cast("double").alias("t"), have["agent_id"].cast("int").alias("agent_id"), have["x"].cast("double").alias("x"), have["y"].cast("double").alias("y"))


def vitals(line: Column) -> Column:
    """The struct of a JSON line, aliases resolved; null fields for what is not there or no JSON."""
    j = F.from_json(line, VITALS)
    return F.struct(j["red"].alias("red"), j["ir"].alias("ir"), F.coalesce(j["bpm"], j["heart_rate"]).alias("bpm"), j["bpm_avg"].alias("bpm_avg"), j["spo2"].alias("spo2"), F.coalesce(j["resp"], j["respiration"]).alias("resp"), j["ts"].alias("ts"), F.coalesce(j["sid"], j["patient_id"]).alias("sid"), F.coalesce(j["source"], F.lit("unknown")).alias("source"), j["timestamp"].alias("timestamp"))


def vitals_line(sample: Column) -> Column:
    """A sample's compact JSON line, null fields left out."""
    return F.to_json(sample)


def newer_than(spark: SparkSession, path: str, since: str) -> DataFrame:
    """(path, modificationTime, length) of the files changed at that time or later."""
    return spark.read.format("binaryFile").load(path).where(F.col("modificationTime") >= F.lit(since).cast("timestamp")).select("path", "modificationTime", "length")


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows in a stated order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def wide_observations(values: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per observation_id with a column for each attribute's name, from (observation_id, attribute_id, value)."""
    names = [r.name for r in attributes.select("name").distinct().orderBy("name").collect()]
    return values.join(attributes, "attribute_id").groupBy("observation_id").pivot("name", names).agg(F.first("value"))
