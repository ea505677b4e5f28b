"""As-of joins, range joins and session linking, as plans whose rows grow with the input and not with its square."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one key that are merged in one task, about, and the bytes a row is taken to have.
MERGED, ROW_BYTES = 200_000, 64


def _ranges(df: DataFrame, at: Column, merged: int) -> tuple[int, float, float]:
    """(how many ranges of equal width, from, to) to cut times into; one if the planner's own estimate says that rows are few.

    Measured in one pass over the times alone. The outermost thousandths lie outside, so that stray times widen nothing.
    """
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= merged * ROW_BYTES:
        return 1, 0.0, 0.0
    n, edges = df.agg(F.count(at), F.percentile_approx(at, [0.001, 0.999], 1000)).first()
    if not edges or edges[0] >= edges[1] or n <= merged:
        return 1, 0.0, 0.0
    return -(-n // merged), edges[0], edges[1]


def asof(left: DataFrame, right: DataFrame, on: str | list[str], left_time: str, right_time: str, take: list[str], inclusive: bool = True, merged: int = MERGED) -> DataFrame:
    """left with the columns take of the last row of right whose time is not after (or before) left's, null if there is none.

    Time is cut into ranges of equal width, so that a key of very many rows is not one group; a range is found by
    arithmetic, however many there are. Both sides go through one sorted window per key and range and are merged there; no
    pairs are made. Each range begins with the last row of right before it, found among the ranges' own last rows. Of
    right's rows of one time the greatest by take counts; rows of left without a time find nothing.
    """
    keys = [on] if isinstance(on, str) else on
    val = F.struct(*[F.col(c) for c in take])
    kind = dict(left.dtypes)[left_time]
    number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda c: c)
    ranges, low, high = _ranges(left.select(left_time), number(F.col(left_time)).cast("double"), merged)
    cell = F.coalesce(F.width_bucket(number(F.col("_t")).cast("double"), F.lit(low), F.lit(high), F.lit(ranges)), F.lit(0)) if ranges > 1 else F.lit(0).cast("long")
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 if inclusive else 0).alias("_o"), F.struct(*left.columns).alias("_l")).withColumn("_c", cell)
    r = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).cast(kind).alias("_t")).agg(F.max(val).alias("_r")).withColumn("_c", cell)
    u = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumns({"_o": F.lit(0 if inclusive else 1), "_l": F.lit(None).cast(l.schema["_l"].dataType)}))
    if ranges > 1:
        own = l.select(*keys, "_c").distinct().withColumn("_v", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.groupBy(*keys, "_c").agg(F.max_by("_r", "_t").alias("_v")))
        before = Window.partitionBy(*keys).orderBy("_c").rangeBetween(Window.unboundedPreceding, -1)
        carried = own.withColumn("_r", F.last("_v", True).over(before)).where("_r is not null").select(*keys, "_c", "_r").distinct()
        u = u.unionByName(carried.withColumns({"_t": F.lit(None).cast(kind), "_o": F.lit(2), "_l": F.lit(None).cast(l.schema["_l"].dataType)}))
    w = Window.partitionBy(*keys, "_c").orderBy(F.asc_nulls_first("_t"), "_o").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("_v", F.last("_r", True).over(w)).where("_l is not null").select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in take])


def valid_at(facts: DataFrame, history: DataFrame, on: str, at: str, start: str, end: str, value: str, default: float, name: str = "value") -> DataFrame:
    """facts with the value of the newest period [start, end) that holds at, an open end being null; else default.

    The newest period by start is found as of the day and kept if it has not ended. Periods that begin later end earlier ones.
    """
    h = history.select(F.col(on), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_w"))
    j = asof(facts, h, on, at, "_s", ["_e", "_w"])
    live = F.col("_w").isNotNull() & (F.col("_e").isNull() | (F.col("_e") > F.col(at)))
    return j.withColumns({name: F.when(live, F.col("_w")).otherwise(F.lit(default)), "origin": F.when(live, "history").otherwise("fallback")}).drop("_e", "_w")


def within(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, distance: float) -> DataFrame:
    """Pairs of rows of equal keys with |a - b| <= distance: an equi-join on cells of that width, each row of right in three."""
    cell = lambda c: F.floor(F.col(c) / distance)
    r = right.withColumn("_c", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return left.withColumn("_c", cell(a)).join(r, [*on, "_c"]).where(F.abs(F.col(a) - F.col(b)) <= distance).drop("_c")


def islands(df: DataFrame, by: str | list[str], at: str, gap: float, name: str = "island") -> DataFrame:
    """df with the number of each run of rows no more than gap apart."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_n", new).withColumn(name, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


#: Seconds that starts and durations of recordings of one session may differ, or a share of the longer one.
START_S, DURATION_S, DURATION_SHARE = 600.0, 600.0, 0.15
#: Groups of one owner that are linked in one call.
AT_ONCE = 64


def sessions_match(a, b) -> bool:
    """Whether two recordings (sport, start, date, pipeline, duration) may be of one session."""
    if a["sport"] and b["sport"] and a["sport"].lower() != b["sport"].lower():
        return False
    if pd.notna(a["start"]) and pd.notna(b["start"]):
        if abs(a["start"] - b["start"]) > START_S:
            return False
    elif a["date"] != b["date"] or a["pipeline"] == b["pipeline"]:
        return False
    longer, delta = max(a["duration"] or 0, b["duration"] or 0), abs((a["duration"] or 0) - (b["duration"] or 0))
    return longer > 0 and (delta <= DURATION_S or delta <= DURATION_SHARE * longer)


def primary_score(r) -> float:
    """Rank of a recording within a session: with power first, then by source, then by duration."""
    maker = f"{r.get('pipeline') or ''} {r.get('manufacturer') or ''}".lower()
    base = 1e6 + min(r["power"], 2000) if pd.notna(r.get("power")) and r["power"] > 0 else 0.0
    base += 50_000 if "srm" in maker or "email" in maker else 40_000 if any(m in maker for m in ("quarq", "stages", "power2max", "favero", "wahoo", "garmin")) else 10_000 if "polar" in maker else 0
    return base + min(r["duration"] or 0, 86_400)


def link_sessions(activities: DataFrame, owner: str = "owner") -> DataFrame:
    """activities (owner, id, sport, start, date, pipeline, manufacturer, power, duration) with session and is_primary.

    In order of start, date and id each row not yet taken gathers every later row that matches it; the first of the highest
    score is primary. An owner's rows are split wherever no match can span: at gaps of over START_S between starts, and,
    beside days with a recording that has no start, at two days. Within a group a row is compared only with rows that start
    within START_S of it or, where a start is missing, with those of its day.
    """
    day = F.unix_timestamp(F.col("date").cast("timestamp")).cast("double")
    at = F.coalesce(F.col("start").cast("double"), day)
    flagged = F.max(F.col("start").isNull().cast("int")).over(Window.partitionBy(owner, "date")) == 1
    w = Window.partitionBy(owner).orderBy("_e", "date", "id")
    cut = activities.withColumns({"_e": at, "_f": flagged})
    gap = F.when(F.col("_f") | F.lag("_f").over(w), 172_800.0).otherwise(START_S)
    cut = cut.withColumn("_n", F.when(F.col("_e") - F.lag("_e").over(w) <= gap, 0).otherwise(1))
    cut = cut.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n", "_e", "_f")
    cut = cut.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(owner, "_g")))
    alone = cut.where("_m = 1").select(owner, "id", F.col("id").alias("session"), F.lit(True).alias("is_primary"))
    fields = ["id", "sport", "start", "date", "pipeline", "manufacturer", "power", "duration"]

    def linked(rows: list[dict]) -> list[tuple]:
        starts = [r["start"] if pd.notna(r["start"]) else None for r in rows]
        of_day, timed = {}, [i for i, s in enumerate(starts) if s is not None]
        for i, r in enumerate(rows):
            of_day.setdefault(r["date"], []).append(i)
        times = [starts[i] for i in timed]
        taken, out = set(), []
        for i, seed in enumerate(rows):
            if i in taken:
                continue
            if starts[i] is None:
                near = of_day[seed["date"]]
            else:
                until = bisect.bisect_right(times, starts[i] + START_S)
                near = timed[bisect.bisect_left(times, starts[i]) : until] + [j for j in of_day[seed["date"]] if starts[j] is None]
            group = [i] + sorted(j for j in set(near) if j > i and j not in taken and sessions_match(seed, rows[j]))
            taken.update(group)
            best = max(group, key=lambda j: (primary_score(rows[j]), -j))
            out += [(rows[j][owner], rows[j]["id"], seed["id"], j == best) for j in group]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(_s=pdf["start"].fillna(0)).sort_values(["_g", "_s", "date", "id"], kind="stable").to_dict("records")
        out = [x for _, part in itertools.groupby(rows, key=lambda r: r["_g"]) for x in linked(list(part))]
        return pd.DataFrame(out, columns=[owner, "id", "session", "is_primary"])

    types = dict(activities.dtypes)
    several = cut.where("_m > 1").select(owner, *fields, "_g").groupBy(owner, F.floor(F.col("_g") / AT_ONCE))
    return alone.unionByName(several.applyInPandas(run, f"{owner} {types[owner]}, id {types['id']}, session {types['id']}, is_primary boolean"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] | None = None, untouched: list[str] | None = None) -> DataFrame:
    """table with the rows of new put in or over those of the same keys.

    Of a row that is there already, columns keep_old keep what is not null, and columns untouched stay as they are.
    """
    keep, same = set(keep_old or []), set(untouched or [])
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    j = table.withColumn("_old", F.lit(True)).join(n, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys], "full")

    def pick(c: str) -> Column:
        if c in keep:
            return F.coalesce(c, f"_n_{c}")
        taken = F.col("_old").isNull() if c in same else F.col("_new")
        return F.when(taken, F.col(f"_n_{c}")).otherwise(F.col(c))

    return j.select(*[pick(c).alias(c) if c in new.columns else F.col(c) for c in table.columns])


def daily_loads(activities: DataFrame) -> DataFrame:
    """(owner, date, total_tss, total_duration_s, ride_count, primary_sport) of the rows that count; the first sport by name."""
    a = activities.where("counts_for_load")
    return a.groupBy("owner", "date").agg(F.sum("tss").alias("total_tss"), F.sum("duration").alias("total_duration_s"), F.count(F.lit(1)).alias("ride_count"), F.min("sport").alias("primary_sport"))
