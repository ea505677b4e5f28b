"""Training load: ride metrics, workload ratios, monotony, fitness and fatigue, planning and nutrition.

Daily frames have series_id, day and load; the n days of a window are n rows, as rest days may be absent; densify() puts
them in.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, ratio
from tidewave.operators.series import ID, _fold, over, rk4

#: Time constants in days and gains of the two-compartment model.
PMC = {"tau_fitness": 42.0, "tau_fatigue": 7.0, "gain_fitness": 1.0, "gain_fatigue": 1.0, "rule": "ewma", "baseline": 0.0}
BANISTER = {"tau_fitness": 42.0, "tau_fatigue": 7.0, "gain_fitness": 1.0, "gain_fatigue": 2.0, "rule": "decay", "baseline": 0.0}


def densify(df: DataFrame, day: str = "day", load: str = "load") -> DataFrame:
    """Every day of each series from its first to its last, with load 0 where there was none."""
    days = df.groupBy(ID).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return days.join(df, [ID, day], "left").withColumn(load, F.coalesce(load, F.lit(0.0)))


def acwr(df: DataFrame, acute: int = 7, chronic: int = 28, day: str = "day", load: str = "load") -> DataFrame:
    """acute and chronic means over the last rows, their ratio (0 if chronic is not above 0) and its risk class, for every day."""
    a, c = (F.avg(load).over(over((-(n - 1), 0), at=day)) for n in (acute, chronic))
    r = F.when(c > 0, F.try_divide(a, c)).otherwise(0.0)
    return df.withColumns({"acute": a, "chronic": c, "acwr": r}).withColumn("risk", acwr_class(F.col("acwr")))


def acwr_class(r: Column) -> Column:
    return F.when(r < 0.8, "Low").when(r <= 1.3, "Moderate").when(r <= 1.5, "High").otherwise("Very High")


def ewma_acwr(df: DataFrame, acute: int = 7, chronic: int = 28, day: str = "day", load: str = "load") -> DataFrame:
    """Ratio of two exponentially weighted means with weights 2 / (span + 1)."""
    d = df.withColumns({"i": F.col(day), "x": F.col(load).cast("double")})
    for n, span in (("acute", acute), ("chronic", chronic)):
        w = 2.0 / (span + 1)
        d = _fold(d, lambda last, x, w=w: w * x + (1 - w) * last, n)
    return d.withColumn("acwr", F.when(F.col("chronic") > 0, F.try_divide("acute", "chronic")).otherwise(0.0)).drop("i", "x")


def monotony_strain(df: DataFrame, window_days: int | None = None, day: str = "day", load: str = "load") -> DataFrame:
    """Mean over population deviation of the rows so far (or the last window_days), 1 without variation; strain is monotony times the sum."""
    w = over((-(window_days - 1) if window_days else Window.unboundedPreceding, 0), at=day)
    m = F.when(F.stddev_pop(load).over(w) > 0, F.try_divide(F.avg(load).over(w), F.stddev_pop(load).over(w))).otherwise(1.0)
    return df.withColumn("monotony", m).withColumn("strain", F.col("monotony") * F.sum(load).over(w))


def step(state: tuple[float, float], load: float, p: dict = PMC) -> tuple[float, float]:
    """(fitness, fatigue) after one day; a load that is negative or not finite counts as 0."""
    w = load if load is not None and math.isfinite(load) and load > 0 else 0.0
    if p["rule"] == "ewma":
        return state[0] + (w - state[0]) / p["tau_fitness"], state[1] + (w - state[1]) / p["tau_fatigue"]
    return state[0] * math.exp(-1 / p["tau_fitness"]) + w, state[1] * math.exp(-1 / p["tau_fatigue"]) + w


def _recursion(w: np.ndarray, keep: float, gain: float, start: float) -> np.ndarray:
    """s[n] = keep * s[n - 1] + gain * w[n], 64 days at once by sums of what is left of each."""
    out = np.empty(len(w))
    days = 64 if keep > 0.5 else 1  # so that no power of keep gets too small to divide by
    for at in range(0, len(w), days):
        part = w[at : at + days]
        left = keep ** np.arange(1, len(part) + 1) if days > 1 else np.ones(1)
        out[at : at + days] = left * start + left * np.cumsum(gain * part / left) if days > 1 else keep * start + gain * part
        start = out[at + len(part) - 1]
    return out


def simulate(loads, p: dict = PMC, state: tuple[float, float] = (0.0, 0.0)) -> pd.DataFrame:
    """fitness, fatigue, form (gained fitness less fatigue) and performance after each day; step() for all of them."""
    w = np.array([np.nan if v is None else v for v in loads], float)
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    ewma = p["rule"] == "ewma"
    both = []
    for start, tau in zip(state, (p["tau_fitness"], p["tau_fatigue"]), strict=True):
        both.append(_recursion(w, 1 - 1 / tau if ewma else math.exp(-1 / tau), 1 / tau if ewma else 1.0, start))
    form = p["gain_fitness"] * both[0] - p["gain_fatigue"] * both[1]
    return pd.DataFrame({"fitness": both[0], "fatigue": both[1], "form": form, "performance": p["baseline"] + form})


def pulse_response(df: DataFrame, p: dict = PMC, day: str = "day", load: str = "load") -> DataFrame:
    """fitness, fatigue and form of every day of each series; with PMC these are CTL, ATL and TSB."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day).reset_index(drop=True)
        return pd.concat([pdf, simulate(pdf[load].tolist(), p)[["fitness", "fatigue", "form"]]], axis=1)

    schema = df.withColumns({c: F.lit(0.0) for c in ("fitness", "fatigue", "form")}).schema
    return df.groupBy(ID).applyInPandas(run, schema)


def forecast(state: tuple[float, float], loads, p: dict = PMC) -> pd.DataFrame:
    return simulate(loads, p, state)


def recovery_days(state: tuple[float, float], target_form: float, load: float = 0.0, most: int = 60, p: dict = PMC) -> int | None:
    """Days of a constant load until form reaches the target; None if not within most."""
    for day in range(most + 1):
        if p["gain_fitness"] * state[0] - p["gain_fatigue"] * state[1] >= target_form:
            return day
        state = step(state, load, p)
    return None


def impulse_response(days: int, p: dict = PMC) -> pd.DataFrame:
    return simulate([1.0] + [0.0] * max(days - 1, 0), p)


def simulate_continuous(load_at, t0: float, t1: float, dt: float, p: dict = PMC, state=(0.0, 0.0)):
    """The model as a differential equation, by fixed steps."""
    k = 1.0 if p["rule"] == "ewma" else None

    def f(t, y):
        w = max(load_at(t), 0.0)
        return np.array([((w if k else w * tau) - v) / tau for v, tau in zip(y, (p["tau_fitness"], p["tau_fatigue"]), strict=True)])

    return rk4(f, t0, t1, np.asarray(state, float), dt)


#: Form under which recovery and over which overload is suggested, half the width of the band around 0 for
#: maintenance, ratios of fatigue to fitness and of acute to chronic load that speak for recovery (high) or overload (low).
SUGGEST = {"form_recovery": -20.0, "form_overload": 10.0, "form_half": 12.0, "fatigue_high": 1.15, "fatigue_low": 0.95, "acwr_high": 1.30, "acwr_low": 0.80}
GOALS = ("recovery", "maintenance", "overload")


# What form gives each goal. Of recovery: at its threshold, by how much more at so far below it, before it and
# with fresh form falling off over so many points. Of maintenance: at no form, less by so much at half the band and then by
# each band, up to so many bands, and beyond. Of overload: at its threshold, by how much more so far above it, before it, and
# with no fresh form, which falls off over so many points.
FORM_RECOVERY = {"at": 1.0, "more": 0.5, "over": 40.0, "before": 0.55, "fresh": 0.15, "fall": 30.0}
FORM_MAINTENANCE = {"at": 1.0, "within": 0.35, "beyond": 0.65, "step": 0.25, "bands": 2.5, "far": 0.15}
FORM_OVERLOAD = {"at": 1.0, "more": 0.35, "over": 25.0, "before": 0.70, "tired": 0.08, "fall": 40.0}
# What is added to (recovery, maintenance, overload) if fatigue is high or low for the fitness, or the workload ratio
# is high or low: a constant, and a factor of how far it lies beyond its threshold, which counts up to so far.
ADDED = {
    "tired": ((0.35, 0.5), (-0.05, 0.0), (-0.40, -0.6), 0.5),
    "fresh": ((-0.15, 0.0), (0.0, 0.0), (0.20, 0.4), 0.4),
    "spiked": ((0.55, 0.6), (0.25, 0.2), (-1.10, -0.9), 0.8),
    "light": ((-0.10, 0.0), (0.0, 0.0), (0.25, 0.35), 0.5),
}


def goal_scores(fitness: Column, fatigue: Column, form: Column, acwr_: Column, p: dict = SUGGEST) -> dict[str, Column]:
    """The score of each goal, from form, fatigue relative to fitness, and the workload ratio where it is known.

    All weights stand in the tables above; suggestions hang on them.
    """
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    deep, wide, high = FORM_RECOVERY, FORM_MAINTENANCE, FORM_OVERLOAD
    low, top, off = p["form_recovery"], p["form_overload"], F.abs(form) / p["form_half"]
    base = (
        F.when(form <= low, deep["at"] + deep["more"] * F.least(low - form, F.lit(deep["over"])) / deep["over"]).when(form < 0, deep["before"] * one(form / low)).otherwise(deep["fresh"] * one(F.exp(-form / deep["fall"]))),
        F.when(off <= 1.0, wide["at"] - wide["within"] * off).when(off <= wide["bands"], wide["beyond"] - wide["step"] * (off - 1.0)).otherwise(wide["far"]),
        F.when(form >= top, high["at"] + high["more"] * F.least((form - top) / high["over"], F.lit(1.0))).when(form > 0, form / max(top, 1.0) * high["before"]).otherwise(high["tired"] * one(1.0 + form / high["fall"])),
    )
    share = F.greatest(fatigue, F.lit(0.0)) / F.greatest(fitness, F.lit(1e-6))
    known = acwr_.isNotNull() & ~F.isnan(acwr_)
    beyond = {"tired": share - p["fatigue_high"], "fresh": p["fatigue_low"] - share, "spiked": acwr_ - p["acwr_high"], "light": p["acwr_low"] - acwr_}
    holds = {"tired": share >= p["fatigue_high"], "fresh": share <= p["fatigue_low"], "spiked": known & (acwr_ >= p["acwr_high"]), "light": known & (acwr_ <= p["acwr_low"])}

    def added(case: str, goal: int) -> Column:
        constant, factor = ADDED[case][goal]
        return F.lit(constant) + factor * F.least(beyond[case], F.lit(ADDED[case][3]))

    either = lambda a, b, goal: F.when(holds[a], added(a, goal)).when(holds[b], added(b, goal)).otherwise(0.0)
    return {name: F.greatest(base[k] + either("tired", "fresh", k) + either("spiked", "light", k), F.lit(0.0)) for k, name in enumerate(GOALS)}


def suggest_goals(df: DataFrame, p: dict = SUGGEST) -> DataFrame:
    """df (fitness, fatigue, form, acwr) with goal, confidence and the scores recovery, maintenance and overload.

    The goal of the highest score, the first on ties; confidence grows with the distance to the second, from 0.15 to 1.
    """
    d = df.withColumns(goal_scores(*(F.col(c) for c in ("fitness", "fatigue", "form", "acwr")), p))
    ordered = F.sort_array(F.array(*GOALS), asc=False)
    goal = F.when((F.col("recovery") >= F.col("maintenance")) & (F.col("recovery") >= F.col("overload")), "recovery").when(F.col("maintenance") >= F.col("overload"), "maintenance").otherwise("overload")
    return d.withColumns({"goal": goal, "confidence": F.greatest(F.lit(0.15), F.least(F.lit(1.0), (ordered[0] - ordered[1]) / 1.2))})


#: A day's load as shares of the chronic load, and for each goal the least, greatest and desired mean share.
SHARES = (0.0, 0.25, 0.45, 0.70, 1.0, 1.20, 1.40)
BANDS = {"recovery": (0.20, 0.55, 0.38), "maintenance": (0.85, 1.15, 1.0), "overload": (1.15, 1.40, 1.25)}
#: Up to so many candidates are all tried, else so many are kept each day.
MOST_PLANS, BEAM = 20_000, 64


def _advance(fitness, fatigue, w, p: dict):
    if p["rule"] == "ewma":
        return fitness + (w - fitness) / p["tau_fitness"], fatigue + (w - fatigue) / p["tau_fatigue"]
    return fitness * math.exp(-1 / p["tau_fitness"]) + w, fatigue * math.exp(-1 / p["tau_fatigue"]) + w


def _form_after(start: tuple[float, float], days: np.ndarray, p: dict) -> np.ndarray:
    """Form after the loads in each row of days."""
    a, b = np.full(len(days), start[0]), np.full(len(days), start[1])
    for w in days.T:
        a, b = _advance(a, b, w, p)
    return p["gain_fitness"] * a - p["gain_fatigue"] * b


def rate_plans(days: np.ndarray, goal: str, chronic: float, start: tuple[float, float], p: dict = PMC) -> tuple[np.ndarray, np.ndarray]:
    """(whether its mean load lies in the goal's band, cost) of each row of daily loads."""
    c = max(chronic, 1.0)
    lo, hi, aim = BANDS[goal]
    mean, n = days.mean(axis=1), days.shape[1]
    share = mean / c
    ok = (share >= lo - 1e-12) & (share <= hi + 1e-12)
    off = (np.abs(days - max(aim * c, 1.0)) / max(aim * c, 1.0)).mean(axis=1)
    before = p["gain_fitness"] * start[0] - p["gain_fatigue"] * start[1]
    gain = _form_after(start, days, p) - before
    if goal == "recovery":
        cost = 1.2 * np.abs(share - aim) + 0.8 * off
        rests = (days < 1.0).mean(axis=1)
        cost += np.where(rests > 0.67, 0.4 * rests, 0.0)
        most = max(float(_form_after(start, np.zeros((1, n)), p)[0]) - before, 0.0)
        return ok, cost - np.where(gain > 0, 0.03 * np.minimum(gain / most if most > 1e-6 else 1.0, 1.0), 0.0)
    if goal == "maintenance":
        spread = days.std(axis=1) / np.where(mean < 1e-9, 1.0, mean) * ((mean >= 1e-9) & (n > 1))
        flat = (np.ptp(days, axis=1) / np.maximum(mean, 1.0) < 0.08) | (n < 2)
        extreme = (np.maximum(0.30 - days / c, 0.0) + np.maximum(days / c - 1.35, 0.0)).sum(axis=1)
        return ok, 0.5 * np.abs(share - 1.0) + 0.55 * np.abs(spread - 0.28) + 0.45 * flat + 0.4 * extreme
    hard, run, longest = days + 1e-9 >= 1.20 * c, np.zeros(len(days), int), np.zeros(len(days), int)
    for day in hard.T:
        run = (run + 1) * day
        longest = np.maximum(longest, run)
    return ok & (mean > c), 1.1 * np.abs(share - aim) + 0.45 * off + 0.20 * np.maximum(longest - 2, 0) + 0.1 * (gain > 1.0)


def plan(history: list[float], goal: str, horizon: int = 4, p: dict = PMC, least_history: int = 7, max_factor: float = 1.5) -> dict:
    """The best daily loads for the next 1 to 10 days for a goal, after daily loads from the oldest to the newest.

    A day is a share of the chronic load, the mean of the last 28 days. Plans whose mean lies in the goal's band come first,
    then those of the least cost in millionths, then those whose first days are lighter. All plans are tried if there are at
    most MOST_PLANS, else the best BEAM of the days so far are carried on. The workload ratio is given for information.
    """
    if not 1 <= horizon <= 10:
        raise ValueError("a horizon of 1 to 10 days is needed")
    if len(history) < max(least_history, 1):
        raise ValueError(f"{max(least_history, 1)} days of history are needed")
    start = (0.0, 0.0)
    for w in history:
        start = step(start, w, p)
    chronic = float(np.mean(history[-28:]))
    chronic = chronic if math.isfinite(chronic) and chronic > 1.0 else 50.0
    most = max(max(max(history), chronic) * max_factor, 1.0)
    loads = np.clip(np.array(SHARES) * chronic, 0.0, most)

    def ranked(days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok, cost = rate_plans(days, goal, chronic, start, p)
        return np.lexsort((np.trunc(cost * 1e6), ~ok)), ok, cost

    if len(loads) ** horizon <= MOST_PLANS:
        days = loads[np.stack([(np.arange(len(loads) ** horizon) // len(loads) ** d) % len(loads) for d in range(horizon)], axis=1)]
    else:
        days = np.zeros((1, 0))
        for _ in range(horizon):
            days = np.concatenate([np.repeat(days, len(loads), axis=0), np.tile(loads, len(days))[:, None]], axis=1)
            days = days[ranked(days)[0][:BEAM]]
    order, ok, cost = ranked(days)
    best, recent = days[order[0]], [*history, *days[order[0]].tolist()][-28:]
    form = p["gain_fitness"] * start[0] - p["gain_fatigue"] * start[1]
    workload = (float(np.mean(recent[-7:]) / np.mean(recent)) if np.mean(recent) > 0 else 0.0) if len(history) + horizon >= 28 else None
    return {"loads": best.tolist(), "success": bool(ok[order[0]]), "score": float(cost[order[0]]), "form_start": form, "form_end": float(_form_after(start, best[None], p)[0]), "chronic": chronic, "mean_load": float(best.mean()), "load_share": float(best.mean() / max(chronic, 1.0)), "acwr": workload}


def plans(df: DataFrame, goals: tuple[str, ...] = GOALS, horizon: int = 4, p: dict = PMC, day: str = "day", load: str = "load") -> DataFrame:
    """One row for each series of at least a week and each goal: loads, success, score, form_start, form_end, chronic and load_share."""
    names = ("success", "score", "form_start", "form_end", "chronic", "load_share")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        history = pdf.sort_values(day)[load].astype(float).tolist()
        rows = [(g, plan(history, g, horizon, p)) for g in goals] if len(history) >= 7 else []
        return pd.DataFrame([(pdf[ID].iloc[0], g, got["loads"], *(got[c] for c in names)) for g, got in rows], columns=[ID, "goal", "loads", *names])

    return df.groupBy(ID).applyInPandas(run, f"{ID} {dict(df.dtypes)[ID]}, goal string, loads array<double>, success boolean, score double, form_start double, form_end double, chronic double, load_share double")


def ride_metrics(df: DataFrame, ftp: Column | float, at: str = "t_s", power: str = "power_w", by: list[str] | None = None, also: list[Column] | None = None) -> DataFrame:
    """One row per series of samples, one a second: avg and max power, np, intensity, tss, work_kj, duration_s.

    by: the columns that name a series, series_id if there are none; also: further aggregates of a series' samples, taken
    in the same pass.

    np is the fourth root of the mean fourth power of the means of full 30-sample windows (of the samples if fewer);
    missing power is 0; the duration is the last time, at least 1. tss = duration np intensity / (ftp 36).
    """
    by = by or [ID]
    w = over((-29, 0), id_=by, at=at)
    p = F.coalesce(F.col(power), F.lit(0.0))
    d = df.select(*(df.columns if also else by), F.col(at).alias("_t"), p.alias("_p"), F.avg(p).over(w).alias("_m"), F.count(F.lit(1)).over(w).alias("_k"))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_p").alias("avg_power"),
        F.max("_p").alias("max_power"),
        F.avg(F.when(F.col("_k") == 30, F.pow("_m", F.lit(4.0)))).alias("_full"),
        F.avg(F.pow("_p", F.lit(4.0))).alias("_raw"),
        F.greatest(F.max("_t").cast("double"), F.lit(1.0)).alias("duration_s"),
        *(also or []),
    )
    f = ftp if isinstance(ftp, Column) else F.lit(float(ftp))
    g = g.withColumn("np", F.pow(F.coalesce("_full", "_raw"), F.lit(0.25))).withColumn("intensity", ratio(F.col("np"), f, 0.0))
    g = g.withColumn("tss", ratio(F.col("duration_s") * F.col("np") * F.col("intensity"), f * 36, 0.0)).withColumn("work_kj", F.col("avg_power") * F.col("duration_s") / 1000)
    return g.drop("_full", "_raw")


def highest_rolling(df: DataFrame, window: int, at: str = "i", x: str = "x") -> DataFrame:
    """(series_id, best): the greatest sample, but the mean where the window is as long as the series or longer."""
    return df.groupBy(ID).agg(F.when(F.count(x) <= window, F.avg(x)).otherwise(F.max(x)).alias("best"))


def power_bests(df: DataFrame, durations: list[int], at: str = "i", x: str = "x") -> DataFrame:
    """(series_id, duration, best): the greatest mean of so many samples in a row; null if there are fewer."""
    cols = {f"m{d}": F.when(F.count(x).over(over((-(d - 1), 0), at=at)) == d, F.avg(x).over(over((-(d - 1), 0), at=at))) for d in durations}
    g = df.withColumns(cols).groupBy(ID).agg(*[F.max(f"m{d}").alias(f"b{d}") for d in durations])
    return g.select(ID, F.explode(F.array(*[F.struct(F.lit(d).alias("duration"), F.col(f"b{d}").alias("best")) for d in durations])).alias("s")).select(ID, "s.*")


def exceedances(df: DataFrame, threshold: float, least: int = 1, at: str = "i", x: str = "x") -> DataFrame:
    """(series_id, start, end, n): runs of at least so many samples of threshold or more, as gaps and islands."""
    w = over(at=at)
    d = df.select(ID, F.col(at).alias("i"), (F.col(x) >= threshold).alias("on"), F.row_number().over(w).alias("k"))
    d = d.where("on").withColumn("g", F.col("k") - F.row_number().over(over(at="i")))
    return d.groupBy(ID, "g").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("g")


def movement_load(df: DataFrame, action_weight: float = 5.0, accel: float = 0.8, t: str = "t", speed: str = "speed") -> DataFrame:
    """(series_id, distance, peak, mean, accelerations, decelerations, load): speed over time and counts of |dv/dt| above accel."""
    w = over(at=t)
    dt = F.col(t) - F.lag(t).over(w)
    a = F.when(dt > 0, (F.col(speed) - F.lag(speed).over(w)) / dt).otherwise(0.0)
    d = df.select(ID, F.col(speed).alias("v"), (F.col(speed) * F.coalesce(F.lead(t).over(w) - F.col(t), F.lit(0.0))).alias("m"), a.alias("a"))
    g = d.groupBy(ID).agg(F.sum("m").alias("distance"), F.max("v").alias("peak"), F.avg("v").alias("mean"), F.count(F.when(F.col("a") > accel, 1)).alias("accelerations"), F.count(F.when(F.col("a") < -accel, 1)).alias("decelerations"))
    return g.withColumn("load", F.col("distance") + action_weight * (F.col("accelerations") + F.col("decelerations")))


def mechanical_load(force: Column, velocity: Column) -> Column:
    """Aggregate: the sum of force times velocity."""
    return F.sum(force * velocity)


def weekly(df: DataFrame, day: str = "day", load: str = "load") -> DataFrame:
    """(series_id, week, days, total) by the Monday of each week."""
    return df.groupBy(ID, F.date_trunc("week", F.col(day)).cast("date").alias("week")).agg(F.count(F.lit(1)).alias("days"), F.sum(load).alias("total"))


#: Multiples of the basal rate for activity levels, and daily deficits in kcal and as shares of active energy.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "very_active": 1.9}
DEFICIT_KCAL = {"small": 250.0, "moderate": 500.0, "large": 750.0}
DEFICIT_SHARE = {"small": 0.25, "moderate": 0.5, "large": 0.75}


def bmi(weight: Column, height: Column) -> Column:
    """kg / m^2; NaN for sizes that are not above 0."""
    return F.when((weight > 0) & (height > 0), F.try_divide(weight, height * height)).otherwise(NAN)


def bmr(weight: Column, height: Column, age: Column, male: Column, adjust_obesity: bool = True) -> Column:
    """Basal kcal a day, whole: 10 kg + 6.25 cm - 5 years + 5 (men) or - 161; above a BMI of 30 a quarter of the excess over 22.5 counts."""
    fair = 22.5 * height * height
    w = F.when(bmi(weight, height) > 30, fair + 0.25 * (weight - fair)).otherwise(weight) if adjust_obesity else weight
    return F.when((weight > 0) & (height > 0) & (age > 0), F.round(10 * w + 625 * height - 5 * age + F.when(male, 5).otherwise(-161))).otherwise(NAN)


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def tdee(basal: Column, activity: Column) -> Column:
    return F.round(basal * _lookup(ACTIVITY, activity))


def deficit(basal: Column, total: Column, level: Column, of_active: bool = False) -> Column:
    """kcal a day to leave out, never so many that less than the basal rate is eaten."""
    want = (total - basal) * _lookup(DEFICIT_SHARE, level) if of_active else _lookup(DEFICIT_KCAL, level)
    return F.greatest(F.least(want, total - basal), F.lit(0.0))


def weight_loss(weight: float, goal: float, height: float, age: float, male: bool, activity: str, level: str, weeks: int = 79) -> pd.DataFrame:
    """Week by week weight, basal rate and intake until the goal, 7700 kcal a kg, no more than so many weeks."""
    rows, w = [], weight
    for k in range(weeks):
        fair = 22.5 * height**2
        eff = fair + 0.25 * (w - fair) if w / height**2 > 30 else w
        basal = math.floor(10 * eff + 625 * height - 5 * age + (5 if male else -161) + 0.5)
        total = math.floor(basal * ACTIVITY[activity] + 0.5)
        cut = max(min(DEFICIT_KCAL[level], total - basal), 0.0)
        rows.append((k, w, basal, total - cut))
        if w <= goal or cut <= 0:
            break
        w -= cut * 7 / 7700
    return pd.DataFrame(rows, columns=["week", "weight", "bmr", "intake"])


def demo_loads(days: int, base: float = 60.0, variation: float = 20.0) -> list[float]:
    """A weekly pattern of loads without chance."""
    return [max(0.0, base + variation * math.sin(2 * math.pi * d / 7) - (base * 0.6 if d % 7 == 6 else 0)) for d in range(days)]


