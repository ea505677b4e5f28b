"""A catalogue of recorded activities: what is told from a file's path, daily loads, metrics and views, as joins and windows.

Tables are DataFrames with owner: activities (owner, source_file, file_hash, ride_date, ...), daily loads (owner, date,
total_tss, ...) and what is computed from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators import load
from tidewave.plans import joins

#: Calorie split of a deficit into eating less and moving more; tss-like figures by name.
STRATEGIES = {"restriction": (0.75, 0.25), "activity": (0.25, 0.75), "balanced": (0.5, 0.5)}


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def source_key(path: Column, root: str | None = None) -> Column:
    """The path below root, with forward slashes, or else the file's name."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is None:
        return file_name(path)
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(top)), F.substring(p, len(top) + 1, 1 << 30)).otherwise(file_name(path))


def pipeline(path: Column, platform: Column | None = None) -> Column:
    """email, polar or manual, by the path and then by the platform."""
    s, name = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lower(file_name(path))
    polar = s.contains("/polar/") | s.startswith("polar/") | name.startswith("polar_")
    other = F.lit("manual") if platform is None else F.when(F.lower(platform) == "polar", "polar").otherwise("manual")
    return F.when(s.contains("/email/") | s.contains("/inbox/") | s.startswith("email/"), "email").when(polar, "polar").when(s.contains("/manual/") | s.startswith("manual/"), "manual").otherwise(other)


def external_id(path: Column, pipe: Column) -> Column:
    """What stands between polar_ and .fit in the name of a file of that pipeline; else null."""
    found = F.regexp_extract(file_name(path), r"^polar_(.+)\.(fit|FIT)$", 1)
    return F.when((pipe == "polar") & (found != ""), found)


def ride_date(path: Column, start: Column | None = None, modified: Column | None = None) -> Column:
    """yyyy-mm-dd from the file's name (dashes before underscores), else of the start, else of the change of the file; years 1990 to 2100."""
    name = file_name(path)
    dash = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    score = F.replace(F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2})", 1), F.lit("_"), F.lit("-"))
    # choices are elements of arrays, so that none is worked out twice
    found = F.get(F.filter(F.array(dash, score), lambda c: c != ""), F.lit(0))
    options = [found, *[F.date_format(c, "yyyy-MM-dd") for c in (start, modified) if c is not None]]
    fair = F.filter(F.array(*options), lambda c: F.substring(c, 1, 4).cast("int").between(1990, 2100))
    return F.coalesce(F.get(fair, F.lit(0)), F.lit("1970-01-01"))


def stamp_seconds(s: Column) -> Column:
    """Seconds since 1970 of `yyyy-mm-dd hh:mm[:ss]`, with T or Z or not, in UTC; a date alone is its midnight; else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), "Z+$", ""), "T", " ")
    part = lambda k: F.regexp_extract(t, r"^(\d+)-(\d+)-(\d+)(?:\s+(\d+):(\d+)(?::(\d+))?)?", k)
    day = F.unix_date(F.make_date(*[F.try_to_number(part(k), F.lit("9999")).cast("int") for k in (1, 2, 3)]))
    whole = lambda k: F.coalesce(F.when(part(k) != "", part(k)).cast("long"), F.lit(0))
    return F.when(part(1) != "", day.cast("long") * 86400 + whole(4) * 3600 + whole(5) * 60 + whole(6))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, bytes, file_hash): the SHA-256 of the files of a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_hash"))


def not_yet_there(files: DataFrame, activities: DataFrame) -> DataFrame:
    """The files whose hash the catalogue doesn't have, one of each hash, the first by path."""
    w = Window.partitionBy("file_hash").orderBy("path")
    fresh = files.join(activities.select("file_hash").distinct(), "file_hash", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def platform(manufacturer: Column) -> Column:
    """The family of a device by its maker's name."""
    m = F.lower(manufacturer)
    out = F.when(m.contains("garmin"), "garmin").when(m.contains("srm"), "srm").when(m.contains("polar"), "polar").when(m.contains("wahoo"), "wahoo")
    return out.otherwise(m)


#: Columns of a row that is there already which new files never change, and those in which only a null is filled.
KEPT = ["sport", "external_id", "avg_hr_bpm", "max_hr_bpm", "avg_cadence", "max_cadence", "avg_speed_kmh", "max_speed_kmh", "counts_for_load", "is_primary"]
FILLED = ["ingest_pipeline", "external_id"]


def ingest(files: DataFrame, samples: DataFrame, activities: DataFrame, history: DataFrame, fallback_ftp: float, root: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the catalogue after files were taken in, what became of each file), as plans; nothing is written.

    files: (owner, path, bytes, file_hash, manufacturer, product, sport, start, modified, error), samples: (path, t_s, power_w,
    heart_rate_bpm, cadence, speed_mps), history: (sport, since, until, ftp_w). outcomes: (path, source_key, outcome, reason):
    inserted, skipped (the hash is there already, unless forced, or an earlier path has it too, or there are no samples) or
    failed (with the file's error). A row is found again by its source_key and scored anew; of several files of one key the
    last by path counts. The ride's threshold power is that of its sport (cycling if none) on its day. Taking in the same
    files again changes nothing.

    Samples go through one window and one aggregation, and meet their files there. Threshold powers are looked up once for
    each different sport and day of the files. Paths of one folder begin alike, so rows are sorted by a hash of them first.
    """
    by_path = Window.partitionBy("file_hash").orderBy("path")
    known = activities.where("file_hash is not null").select("file_hash").distinct().withColumn("_known", F.lit(True))
    hashed = lambda d: d.withColumn("_h", F.xxhash64("path"))
    finite = lambda c, f: f(F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)))
    others = [finite(c, f).alias(f"{n}_{k}") for c, k in (("heart_rate_bpm", "hr_bpm"), ("cadence", "cadence"), ("speed_mps", "speed_mps")) for n, f in (("avg", F.avg), ("max", F.max))]
    measured = load.ride_metrics(hashed(samples), 1.0, by=["_h", "path"], also=[*others, F.greatest(F.max("t_s"), F.lit(0.0)).alias("_last_s")])
    measured = measured.withColumnsRenamed({"n": "_n", "duration_s": "_duration"}).drop("intensity", "tss")
    seen = hashed(files.join(known, "file_hash", "left")).join(measured, ["_h", "path"], "left").drop("_h")
    seen = seen.withColumns({"source_key": source_key(F.col("path"), root), "_twin": F.row_number().over(by_path) > 1, "_known": F.coalesce("_known", F.lit(False))})
    last = F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("path"))) == 1
    reason = F.when(F.col("error").isNotNull(), F.col("error"))
    if not force:
        reason = reason.when(F.col("_known") | F.col("_twin"), "file_hash already present")
    reason = reason.when(F.col("_n").isNull(), "no samples")
    told = seen.withColumn("reason", reason).withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").when(F.col("reason").isNotNull(), "skipped").otherwise("inserted"))
    outcomes = told.select("path", "source_key", "outcome", "reason")
    new = told.where("outcome = 'inserted'").withColumn("_last", last).where("_last")
    told_day = ride_date(F.col("path"), F.col("start"), F.col("modified"))
    pipe = pipeline(F.col("path"), platform(F.col("manufacturer")))
    sport = F.coalesce(F.when(F.trim("sport") != "", F.trim("sport")), F.lit("cycling"))
    new = new.withColumns({"ride_date": F.to_date(told_day), "ingest_pipeline": pipe, "_sport": sport})
    new = new.withColumn("external_id", external_id(F.col("path"), F.col("ingest_pipeline")))
    h = history.select(F.col("sport").alias("_sport"), F.col("since"), F.col("until"), F.col("ftp_w"))
    least = max(fallback_ftp, 50.0)
    days = files.select(sport.alias("_sport"), told_day.try_cast("date").alias("ride_date")).where("ride_date is not null").distinct()
    rated = joins.valid_at(days, h, "_sport", "ride_date", "since", "until", "ftp_w", least, "ftp_used_w").select("_sport", "ride_date", "ftp_used_w")
    m = new.join(rated, ["_sport", "ride_date"], "left").withColumn("ftp_used_w", F.coalesce("ftp_used_w", F.lit(least)))
    intensity = F.col("np") / F.col("ftp_used_w")
    rows = m.select(
        "owner",
        F.col("source_key").alias("source_file"),
        *["file_hash", "ride_date", "start", F.col("_last_s").alias("duration_s"), "sport", "manufacturer", "product", "ingest_pipeline", "external_id"],
        *[F.col("avg_power").alias("avg_power_w"), F.col("max_power").alias("max_power_w"), F.col("np").alias("np_w"), (F.col("_duration") * F.col("np") * intensity / (F.col("ftp_used_w") * 36)).alias("tss")],
        *[intensity.alias("intensity_factor"), "ftp_used_w", F.col("work_kj").alias("total_work_kj"), "avg_hr_bpm", "max_hr_bpm", "avg_cadence", "max_cadence"],
        *[(F.col(f"{n}_speed_mps") * 3.6).alias(f"{n}_speed_kmh") for n in ("avg", "max")],
        *[F.lit(True).alias("counts_for_load"), F.lit(True).alias("is_primary"), F.col("bytes").alias("file_size")],
    )
    rows = rows.select(*[F.col(c).cast(activities.schema[c].dataType) for c in activities.columns if c in rows.columns])
    return joins.upsert(activities, rows, ["source_file"], keep_old=FILLED, untouched=[c for c in KEPT if c in rows.columns and c not in FILLED]), outcomes


#: The columns of a catalogue of activities.
ACTIVITIES = "owner string, source_file string, file_hash string, ride_date date, start timestamp, duration_s double, sport string, manufacturer string, product string, ingest_pipeline string, external_id string, avg_power_w double, max_power_w double, np_w double, tss double, intensity_factor double, ftp_used_w double, total_work_kj double, avg_hr_bpm double, max_hr_bpm double, avg_cadence double, max_cadence double, avg_speed_kmh double, max_speed_kmh double, counts_for_load boolean, is_primary boolean, file_size long"


def load_metrics(daily: DataFrame) -> DataFrame:
    """daily (owner, date, total_tss, ...) with acute and chronic loads, acwr, risk, ctl, atl, tsb, monotony and strain.

    The workload ratio is null before the 28th day; monotony and strain take all days so far and are null on the first.
    """
    w = Window.partitionBy("owner").orderBy("date")
    d = daily.select(F.col("owner").alias("series_id"), F.col("date").alias("day"), F.col("total_tss").cast("double").alias("load"))
    m = load.monotony_strain(load.acwr(load.pulse_response(d)))
    m = m.select(F.col("series_id").alias("owner"), F.col("day").alias("date"), *[F.col(c).alias(n) for c, n in (("load", "total_tss"), ("acute", "acute_load"), ("chronic", "chronic_load"), ("acwr", "acwr"), ("risk", "risk_level"), ("fitness", "ctl"), ("fatigue", "atl"), ("form", "tsb"), ("monotony", "monotony"), ("strain", "strain"))])
    k = F.row_number().over(w)
    return m.withColumns({c: F.when(k >= 28, F.col(c)) for c in ("acute_load", "chronic_load", "acwr", "risk_level")} | {c: F.when(k >= 2, F.col(c)) for c in ("monotony", "strain")})


def daily_snapshots(daily: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each day's load with the metrics of that day, where there are any."""
    names = ["acwr", "risk_level", "monotony", "strain", "acute_load", "chronic_load"]
    return daily.select("owner", "date", "total_tss", "ride_count", "primary_sport").join(metrics.select("owner", "date", *names), ["owner", "date"], "left")


def ride_summaries(activities: DataFrame) -> DataFrame:
    """Activities with place, their order within an owner: by date, primary and counting ones first, then by source."""
    d = activities.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("tss", "duration_s")} | {c: F.coalesce(c, F.lit(True)) for c in ("is_primary", "counts_for_load")})
    return d.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("ride_date", F.desc("is_primary"), F.desc("counts_for_load"), "source_file")))


def recent_load(daily: DataFrame, metrics: DataFrame, activities: DataFrame) -> DataFrame:
    """Days with their metrics and every ride of the day."""
    m = metrics.select("owner", "date", "acwr", "risk_level", "ctl", "atl", "tsb")
    a = activities.select("owner", F.col("ride_date").alias("date"), "np_w", F.col("tss").alias("ride_tss"))
    return daily.select("owner", "date", "total_tss").join(m, ["owner", "date"], "left").join(a, ["owner", "date"], "left")


def pace_load(df: DataFrame, weight: float, by: str = "series_id", at: str = "t", speed: str = "speed", events: str = "events", relative: bool = False) -> DataFrame:
    """(series_id, external_load): speed over the time to the next sample, and weight for each event.

    The last sample counts for as long as the one before it (relative: one second). 0 for fewer than two samples.
    """
    w = Window.partitionBy(by).orderBy(at)
    ahead, back = F.lead(at).over(w) - F.col(at), F.col(at) - F.lag(at).over(w)
    dt = F.coalesce(F.greatest(ahead, F.lit(0.0)), F.lit(1.0) if relative else F.greatest(F.coalesce(back, F.lit(0.0)), F.lit(0.0)))
    d = df.select(by, (F.col(speed) * dt).alias("_d"), F.col(events).alias("_e"))
    return d.groupBy(by).agg(F.when(F.count(F.lit(1)) >= 2, F.sum("_d") + weight * F.sum("_e")).otherwise(0.0).alias("external_load"))


def markers(df: DataFrame, threshold: float, by: str = "series_id", at: str = "i", x: str = "x") -> DataFrame:
    """(series_id, marks, peak): a mark for each sample, a bar at or above the threshold, else a dot, and the greatest sample or 0."""
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, x))).alias("_s"), F.greatest(F.max(x), F.lit(0.0)).alias("peak"))
    return g.select(by, F.array_join(F.transform("_s", lambda s: F.when(s[x] >= threshold, "│").otherwise("·")), "").alias("marks"), "peak")


def load_of(method: str) -> Column:
    """The figure of ride metrics that a method names: tss, np, work_kj or minutes; tss for another."""
    return {"np": F.col("np"), "work": F.col("work_kj"), "kj": F.col("work_kj"), "duration": F.col("duration_s") / 60.0}.get(method.lower(), F.col("tss"))


def calorie_targets(total: Column, basal: Column, deficit: Column, strategy: str) -> tuple[Column, Column]:
    """(kcal to eat, not under the basal rate; kcal to move) for a deficit split by the strategy."""
    less, more = STRATEGIES[strategy]
    return F.greatest(total - deficit * less, basal), total - basal + deficit * more
