"""Trajectories: long frames (series_id, t, agent_id, x, y). Kinematics, distances, phases, summaries and generators.

Within-agent operators are windows by agent; pairs of agents are made within a frame, where a few dozen agents meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import ratio
from tidewave.operators.series import ID

AGENT = ["series_id", "agent_id"]
#: m/s^2 of an acceleration event, metres within which a carrier holds the ball, and its score's terms.
ACCEL, CARRY_M, NEAR_M, SPEED_WEIGHT = 0.8, 2.0, 0.1, 0.5
#: Pitch sizes in metres and the markings that don't hang on them.
PITCH = {"length": (90.0, 120.0, 105.0), "width": (45.0, 90.0, 68.0), "goal_width": 7.32, "goal_height": 2.44, "outer_depth": 16.5, "inner_depth": 5.5, "spot": 11.0, "circle": 9.15, "corner": 1.0}


def norm(x: Column | str, y: Column | str) -> Column:
    """The root of the sum of squares, as the reference has it: equal steps then differ by the same last bits as in SQL."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.sqrt(x * x + y * y)


def by_agent(frame: tuple[int, int] | None = None):
    w = Window.partitionBy(*AGENT).orderBy("t")
    return w.rowsBetween(*frame) if frame else w


def velocities(df: DataFrame) -> DataFrame:
    """vx, vy, speed and heading of the step that ends at each sample; none for the first, 0 where time stands still."""
    w = by_agent()
    dt = F.col("t") - F.lag("t").over(w)
    v = lambda c: F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).otherwise(F.when(dt.isNotNull(), 0.0))
    d = df.withColumns({"vx": v("x"), "vy": v("y")})
    return d.withColumns({"speed": norm("vx", "vy"), "heading": F.atan2("vy", "vx")})


def accelerations(df: DataFrame) -> DataFrame:
    """velocities() with accel, the change of speed over the step's time, and event: accel, decel or null."""
    w = by_agent()
    d = velocities(df)
    dt = F.col("t") - F.lag("t").over(w)
    a = F.when(F.lag("speed").over(w).isNotNull(), F.when(dt > 0, (F.col("speed") - F.lag("speed").over(w)) / dt).otherwise(0.0))
    return d.withColumn("accel", a).withColumn("event", F.when(F.col("accel") > ACCEL, "accel").when(F.col("accel") < -ACCEL, "decel"))


def along_track(df: DataFrame) -> DataFrame:
    """velocities() with along_accel: the change of velocity along the heading before it; null where time stands still or there is no heading."""
    w = by_agent()
    d = velocities(df).withColumn("_dt", F.col("t") - F.lag("t").over(w))
    lx, ly, ls = F.lag("vx").over(w), F.lag("vy").over(w), F.lag("speed").over(w)
    dot = ((F.col("vx") - lx) * lx + (F.col("vy") - ly) * ly) / F.when(ls > 0, ls)
    return d.withColumn("along_accel", F.when(F.col("_dt") > 0, dot / F.col("_dt"))).drop("_dt")


def bearing(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def cardinal(angle: Column) -> Column:
    """One of eight names, N along +x and on in the turn of the angle."""
    names = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    at = F.pmod(F.round(angle / (math.pi / 4)).cast("int"), F.lit(8))
    return F.get(F.array(*[F.lit(n) for n in names]), at)


def window_bearings(df: DataFrame, seconds: float, ahead: bool = False) -> DataFrame:
    """df with bearing: the direction from the last sample at least so many seconds ago, or to the first so many ahead.

    Where there is none, from the first sample or to the last; null for that sample itself and where nothing moved.
    """
    us, by = F.round(F.col("t") * 1e6).cast("long"), int(seconds * 1e6)
    w = Window.partitionBy(*AGENT).orderBy(us)
    p = F.struct("x", "y")
    far = F.first(p).over(w.rangeBetween(by, Window.unboundedFollowing)) if ahead else F.last(p).over(w.rangeBetween(Window.unboundedPreceding, -by))
    edge = F.last(p).over(w.rangeBetween(0, Window.unboundedFollowing)) if ahead else F.first(p).over(w.rangeBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_p", F.coalesce(far, edge))
    dx, dy = ((F.col(f"_p.{c}") - F.col(c)) * (1 if ahead else -1) for c in "xy")
    return d.withColumn("bearing", F.when(norm(dx, dy) > 1e-9, F.atan2(dy, dx))).drop("_p")


def peak_pace(df: DataFrame) -> DataFrame:
    """velocities() with relative: speed over the agent's greatest, 0 if that is 0."""
    return velocities(df).withColumn("relative", ratio(F.col("speed"), F.max("speed").over(Window.partitionBy(*AGENT)), 0.0))


def pair_distances(df: DataFrame) -> DataFrame:
    """(series_id, t, a, b, distance) of all pairs a < b of the agents of each frame."""
    a = df.select(ID, "t", F.col("agent_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = df.select(ID, "t", F.col("agent_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    return a.join(b, [ID, "t"]).where("a < b").select(ID, "t", "a", "b", norm(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")).alias("distance"))


def nearest_agent(df: DataFrame) -> DataFrame:
    """(series_id, t, agent_id, nearest, distance, free_space): the nearest other agent, the smaller id on ties, and the mean distance of all others.

    A frame is gathered as one row and its agents are compared within it, so that pairs are never shuffled or sorted.
    """
    frames = df.where(F.col(ID).isNotNull() & F.col("t").isNotNull()).groupBy(ID, "t").agg(F.collect_list(F.struct("agent_id", "x", "y")).alias("_f"))
    d = frames.select(ID, "t", "_f", F.explode(F.array_distinct(F.transform("_f", lambda o: o["agent_id"]))).alias("agent_id"))
    own, others = F.filter("_f", lambda o: o["agent_id"] == F.col("agent_id")), F.filter("_f", lambda o: o["agent_id"] != F.col("agent_id"))
    d = d.select(ID, "t", "agent_id", own.alias("_m"), others.alias("_o")).where("size(_o) > 0")
    apart = lambda m: F.transform("_o", lambda o: F.struct(norm(m["x"] - o["x"], m["y"] - o["y"]).alias("distance"), o["agent_id"].alias("o")))
    d = d.select(ID, "t", "agent_id", F.flatten(F.transform("_m", apart)).alias("_d"))
    known = F.filter("_d", lambda p: p["distance"].isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, p: s + p["distance"]) / F.size(known))
    return d.select(ID, "t", "agent_id", F.array_min("_d").alias("m"), mean.alias("free_space")).select(ID, "t", "agent_id", F.col("m.o").alias("nearest"), F.col("m.distance").alias("distance"), "free_space")


def free_space_ahead(df: DataFrame, half_angle: float = math.pi / 4) -> DataFrame:
    """(series_id, t, agent_id, ahead): mean distance of the others within half_angle of the heading, null if none."""
    v = velocities(df).select(ID, "t", "agent_id", "x", "y", "heading")
    o = df.select(ID, "t", F.col("agent_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    j = v.join(o, [ID, "t"]).where("agent_id <> o")
    turn = F.atan2(F.col("oy") - F.col("y"), F.col("ox") - F.col("x")) - F.col("heading")
    off = F.abs(F.atan2(F.sin(turn), F.cos(turn)))
    return j.groupBy(ID, "t", "agent_id").agg(F.avg(F.when(off <= half_angle, norm(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")))).alias("ahead"))


def focal_distances(df: DataFrame, focal: DataFrame) -> DataFrame:
    """df with the distance to the focal point (series_id, t, fx, fy) of its frame."""
    return df.join(focal, [ID, "t"]).withColumn("distance", norm(F.col("x") - F.col("fx"), F.col("y") - F.col("fy")))


def towards_focal(df: DataFrame, focal: DataFrame) -> DataFrame:
    """velocities() with fx, fy, distance and toward: the part of the velocity that points at the focal point."""
    d = focal_distances(velocities(df), focal)
    dot = F.col("vx") * (F.col("fx") - F.col("x")) + F.col("vy") * (F.col("fy") - F.col("y"))
    return d.withColumn("toward", F.when((F.col("distance") > 1e-6) & (F.col("speed") > 0), dot / F.col("distance")))


def carrier(df: DataFrame, focal: DataFrame) -> DataFrame:
    """(series_id, t, carrier): the agent of the greatest 1 / (d + 0.1) + 0.5 speed towards the focal point, the smaller id on
    ties; null if it is over 2 m away."""
    score = 1 / (F.col("distance") + NEAR_M) + SPEED_WEIGHT * F.greatest(F.coalesce("toward", F.lit(0.0)), F.lit(0.0))
    best = towards_focal(df, focal).groupBy(ID, "t").agg(F.max(F.struct(score.alias("s"), (-F.col("agent_id")).alias("k"), "distance")).alias("m"))
    return best.select(ID, "t", F.when(F.col("m.distance") <= CARRY_M, -F.col("m.k")).alias("carrier"))


def path(df: DataFrame) -> DataFrame:
    """(series_id, agent_id, length, net, linearity, rms_off_chord): linearity is net over length, null if either is under 1e-9."""
    w, whole = by_agent(), Window.partitionBy(*AGENT).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seg = F.coalesce(norm(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    d = df.withColumns({"_s": seg, "_x0": F.first("x").over(whole), "_y0": F.first("y").over(whole), "_x1": F.last("x").over(whole), "_y1": F.last("y").over(whole)})
    net = norm(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    off = ratio((F.col("_x1") - F.col("_x0")) * (F.col("y") - F.col("_y0")) - (F.col("_y1") - F.col("_y0")) * (F.col("x") - F.col("_x0")), net)
    g = d.withColumns({"_n": net, "_o": off}).groupBy(*AGENT).agg(F.sum("_s").alias("length"), F.first("_n").alias("net"), F.sqrt(F.avg(F.col("_o") * F.col("_o"))).alias("_r"))
    fine = (F.col("length") > 1e-9) & (F.col("net") > 1e-9)
    return g.select(*AGENT, "length", "net", F.when(fine, F.least(F.col("net") / F.col("length"), F.lit(1.0))).alias("linearity"), F.when(fine, F.col("_r")).alias("rms_off_chord"))


def effort_phase(df: DataFrame, window: float | None = None) -> DataFrame:
    """(series_id, a, b, t, together, against): shares of samples at which a pair's accelerations have the same or opposite signs.

    Over all samples (t is null), or within window seconds to each side of each.
    """
    a = accelerations(df).where("accel is not null").select(ID, "t", "agent_id", "accel")
    j = a.select(ID, "t", F.col("agent_id").alias("a"), F.col("accel").alias("u")).join(a.select(ID, "t", F.col("agent_id").alias("b"), F.col("accel").alias("v")), [ID, "t"]).where("a < b")
    same, opp = F.avg(F.when(F.col("u") * F.col("v") > 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("u") * F.col("v") < 0, 1.0).otherwise(0.0))
    if window is None:
        return j.groupBy(ID, "a", "b").agg(F.lit(None).cast("double").alias("t"), same.alias("together"), opp.alias("against"))
    w = Window.partitionBy(ID, "a", "b").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-int(window * 1e6), int(window * 1e6))
    return j.select(ID, "a", "b", "t", same.over(w).alias("together"), opp.over(w).alias("against"))


def directional_phase(df: DataFrame) -> DataFrame:
    """(series_id, a, b, mean_angle, r, relation): circular mean and resultant of the heading differences of moving pairs.

    in within 45 degrees, opp beyond 135, else out; mix where the resultant is under 0.5.
    """
    v = velocities(df).where("speed > 0").select(ID, "t", "agent_id", "heading")
    j = v.select(ID, "t", F.col("agent_id").alias("a"), F.col("heading").alias("u")).join(v.select(ID, "t", F.col("agent_id").alias("b"), F.col("heading").alias("w")), [ID, "t"]).where("a < b")
    c, s = F.avg(F.cos(F.col("u") - F.col("w"))), F.avg(F.sin(F.col("u") - F.col("w")))
    g = j.groupBy(ID, "a", "b").agg(F.atan2(s, c).alias("mean_angle"), norm(c, s).alias("r"))
    return g.withColumn("relation", F.when(F.col("r") < 0.5, "mix").when(F.abs("mean_angle") <= math.pi / 4, "in").when(F.abs("mean_angle") >= 3 * math.pi / 4, "opp").otherwise("out"))


def closing(df: DataFrame, window: float | None = None) -> DataFrame:
    """(series_id, a, b, closing): mean speed at which pairs come nearer; or, at each t, within window seconds to each side."""
    w = Window.partitionBy(ID, "a", "b").orderBy("t")
    p = pair_distances(df)
    dt = F.col("t") - F.lag("t").over(w)
    c = p.withColumn("_c", F.when(dt > 0, (F.lag("distance").over(w) - F.col("distance")) / dt))
    if window is None:
        return c.groupBy(ID, "a", "b").agg(F.avg("_c").alias("closing"))
    return c.select(ID, "a", "b", "t", F.avg("_c").over(around(window)).alias("closing"))


def around(seconds: float):
    """A pair's samples within so many seconds of each."""
    return Window.partitionBy(ID, "a", "b").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-int(seconds * 1e6), int(seconds * 1e6))


def agent_summary(df: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """(series_id, agent_id, distance, mean_speed, peak_speed, accelerations, decelerations); with agents (agent_id, grp), by group instead."""
    w = by_agent()
    d = accelerations(df).withColumn("_s", F.coalesce(norm(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    g = d.groupBy(*AGENT).agg(F.sum("_s").alias("distance"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("peak_speed"), F.count(F.when(F.col("event") == "accel", 1)).alias("accelerations"), F.count(F.when(F.col("event") == "decel", 1)).alias("decelerations"))
    if agents is None:
        return g
    return g.join(agents, "agent_id").groupBy(ID, "grp").agg(F.count(F.lit(1)).alias("agents"), F.avg("distance").alias("distance"), F.avg("mean_speed").alias("mean_speed"), F.max("peak_speed").alias("peak_speed"), F.sum("accelerations").alias("accelerations"), F.sum("decelerations").alias("decelerations"))


def frame_closest(df: DataFrame, at: float) -> DataFrame:
    """The rows of the frame of each series whose time is closest, the earlier on ties."""
    best = df.groupBy(ID).agg(F.min(F.struct(F.abs(F.col("t") - at).alias("d"), F.col("t").alias("t"))).alias("b")).select(ID, F.col("b.t").alias("t"))
    return df.join(best, [ID, "t"])


#: The labels of actions.
ACTIONS = ("Expansion", "Penetration", "Denial", "Pressure", "Neutral", "Creation", "Conversion", "Prevention")


# Limits of the actions. forward, back, across: movement along the attack over, under, or either way under; speed in
# m/s over; gap and pressed: metres to the nearest opponent over and under, free as a share of the proximity; goal: the share of
# movement along the attack, or metres to the goal if it is known.
LIMITS = {
    "chance": {"forward": 0.72, "speed": 2.8, "gap": 3.5, "goal": (0.55, 12.0)},
    "sure chance": {"forward": 0.85, "speed": 4.0, "gap": 6.0},
    "advance": {"forward": 0.6, "speed": 0.5, "free": 0.5},
    "spread": {"across": 0.5, "speed": 0.25},
    "pressed on the ball": {"pressed": 6.0, "speed": 0.7},
    "chance beside": {"goal": (0.4, 15.0), "forward": 0.45, "speed": 2.2, "gap": 4.5},
    "advance beside": {"forward": 0.3, "speed": 0.3},
    "before the goal": {"goal": (0.3, 15.0)},
    "going back": {"back": -0.05},
    "within reach": {"pressed": 7.5},
    "pressing": {"pressed": 5.0},
    "moving": {"speed": 0.6},
    "pressed on coming": {"pressed": 7.0, "speed": 0.6},
}
# How far, as a share of the proximity, an agent was from the last carrier if it came; metres within which a
# receiver is trapped; and of the confidence: the least, by speed, the speed that counts in full, by room, and metres of it.
CAME, TRAPPED, CONFIDENCE = 1.05, 7.0, (0.3, 0.4, 5.0, 0.3, 10.0)


def classify_actions(df: DataFrame, focal: DataFrame, agents: DataFrame, proximity: float = 12.0, ahead_s: float = 1.0, window_s: float = 1.0) -> DataFrame:
    """(series_id, t, agent_id, action, confidence) of the carrier and of those within proximity of it, else Neutral and 0.

    agents: agent_id, grp, att_x, att_y, and gx, gy of the goal if it is known. What tells: whether an agent has the ball,
    whose group has it, speed, how far movement over the next window_s points along the attack, the nearest opponent among
    those near the carrier, and the distance to the goal or else the movement along the attack. An agent that comes within
    reach of another carrier than before and is pressed is under Pressure. A carrier's advance becomes Neutral if ahead_s
    later another one has the ball and an opponent within 7 m. Agents meet within a frame only, a few dozen at a time.
    """
    goal = [F.col(c).cast("double").alias(c) if c in agents.columns else F.lit(None).cast("double").alias(c) for c in ("gx", "gy")]
    a = agents.select("agent_id", "grp", "att_x", "att_y", *goal)
    d = velocities(df)
    past = window_bearings(df, window_s).select(*AGENT, "t", F.col("bearing").alias("_past"))
    future = window_bearings(df, window_s, ahead=True).select(*AGENT, "t", F.col("bearing").alias("_future"))
    d = d.join(past, [*AGENT, "t"]).join(future, [*AGENT, "t"]).join(a, "agent_id").withColumn("speed", F.coalesce("speed", F.lit(0.0)))
    has = carrier(df, focal)
    frames = Window.partitionBy(ID).orderBy("t")
    times = has.withColumns({"_k": F.row_number().over(frames), "_last": F.lag("carrier").over(frames), "_lt": F.lag("t").over(frames)})
    span = times.groupBy(ID).agg(F.when(F.count("t") > 1, (F.max("t") - F.min("t")) / (F.count("t") - 1)).otherwise(0.04).alias("_dt"), F.count("t").alias("_n"))
    times = times.join(span, ID).withColumn("_ahead", F.greatest(F.lit(ahead_s) / F.col("_dt"), F.lit(1.0)).cast("long") if ahead_s > 0 else F.lit(1))
    at = df.select(ID, "t", F.col("agent_id").alias("carrier"), F.col("x").alias("cx"), F.col("y").alias("cy")).join(agents.select(F.col("agent_id").alias("carrier"), F.col("grp").alias("own")), "carrier")
    here = times.join(at, [ID, "t", "carrier"], "left")
    before = at.select(ID, F.col("t").alias("_lt"), F.col("carrier").alias("_last"), F.col("cx").alias("_bx"), F.col("cy").alias("_by"))
    here = here.join(before, [ID, "_lt", "_last"], "left")
    w = by_agent()
    d = d.withColumns({"_lx": F.lag("x").over(w), "_ly": F.lag("y").over(w)}).join(here.select(ID, "t", "carrier", "own", "cx", "cy", "_bx", "_by"), [ID, "t"])
    d = d.withColumns({"on_ball": F.coalesce(F.col("agent_id") == F.col("carrier"), F.lit(False)), "near": F.coalesce((F.col("agent_id") != F.col("carrier")) & (norm(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= proximity), F.lit(False))})
    other = d.where("near").select(ID, "t", F.col("agent_id").alias("_o"), F.col("grp").alias("_og"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    pressed = d.where("near or on_ball").join(other, [ID, "t"]).where("_o <> agent_id and not (_og <=> grp)")
    pressed = pressed.groupBy(*AGENT, "t").agg(F.min(norm(F.col("_ox") - F.col("x"), F.col("_oy") - F.col("y"))).alias("_m"))
    d = d.join(pressed, [*AGENT, "t"], "left").withColumn("gap", F.coalesce("_m", F.lit(float("inf"))))
    forward = F.when(F.col("_past").isNotNull() & F.col("_future").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos("_future") * F.col("att_x") + F.sin("_future") * F.col("att_y")))).otherwise(0.0)
    d = d.withColumns({"fwd": forward, "to_goal": norm(F.col("gx") - F.col("x"), F.col("gy") - F.col("y"))})
    fwd, speed, gap = F.col("fwd"), F.col("speed"), F.col("gap")
    came = F.coalesce(norm(F.col("_lx") - F.col("_bx"), F.col("_ly") - F.col("_by")) > proximity * CAME, F.lit(False))

    def fits(name: str) -> Column:
        """Whether all limits of an entry of LIMITS hold."""
        parts = []
        for what, bound in LIMITS[name].items():
            if what == "goal":  # metres to the goal where it is known, else the share of movement along the attack
                parts.append(F.when(F.col("to_goal").isNotNull(), F.col("to_goal") < bound[1]).otherwise(F.greatest(fwd, F.lit(0.0)) > bound[0]))
            elif what == "free":
                parts.append(gap > proximity * bound)
            else:
                value, side = {"forward": (fwd, 1), "back": (fwd, -1), "across": (F.abs(fwd), -1), "speed": (speed, 1), "gap": (gap, 1), "pressed": (gap, -1)}[what]
                parts.append(value > bound if side > 0 else value < bound)
        out = parts[0]
        for c in parts[1:]:
            out = out & c
        return out

    ball = F.when(fits("chance"), F.when(fits("sure chance"), "Conversion").otherwise("Creation")).when(fits("advance"), "Penetration").when(fits("spread"), "Expansion").when(fits("pressed on the ball"), "Pressure").otherwise("Neutral")
    mate = F.when(fits("chance beside"), "Creation").when(fits("advance beside"), "Penetration").otherwise("Expansion")
    foe = F.when(fits("before the goal") & (fits("going back") | fits("within reach")), "Prevention").when(fits("pressing"), "Pressure").when(fits("moving"), "Denial").otherwise("Neutral")
    action = F.when(F.col("near") & came & fits("pressed on coming"), "Pressure").when(F.col("on_ball"), ball).when(F.col("near"), F.when(F.col("grp").eqNullSafe(F.col("own")), mate).otherwise(foe)).otherwise("Neutral")
    least, by_speed, fast, by_room, room = CONFIDENCE
    sure = F.when(F.col("on_ball") | F.col("near"), F.least(least + by_speed * F.least(speed / fast, F.lit(1.0)) + F.when(gap > room, by_room).otherwise(0.0), F.lit(1.0))).otherwise(0.0)
    # carriers that gave the ball to one who is pressed when it has it
    then = times.select(ID, (F.col("_k") - F.col("_ahead")).alias("_k"), F.col("carrier").alias("receiver"), F.col("t").alias("_then"))
    passed = times.where("_k <= _n - _ahead").join(then, [ID, "_k"]).where("carrier <> receiver").select(ID, "t", "carrier", "receiver", "_then")
    everyone = df.select(ID, F.col("t").alias("_then"), "agent_id", "x", "y").join(agents.select("agent_id", "grp"), "agent_id")
    there = everyone.select(ID, "_then", F.col("agent_id").alias("receiver"), F.col("grp").alias("_rg"), F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    trapped = passed.join(there, [ID, "_then", "receiver"]).join(everyone, [ID, "_then"]).where("agent_id <> receiver and not (grp <=> _rg)")
    trapped = trapped.where(norm(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")) < TRAPPED).select(ID, "t", F.col("carrier").alias("agent_id"), F.lit(True).alias("_trap")).distinct()
    d = d.withColumns({"action": action, "confidence": sure}).join(trapped, [ID, "t", "agent_id"], "left")
    return d.select(ID, "t", "agent_id", F.when(F.col("_trap") & F.col("action").isin("Penetration", "Creation", "Conversion"), "Neutral").otherwise(F.col("action")).alias("action"), "confidence")


def agreement(found: DataFrame, planted: DataFrame) -> DataFrame:
    """(action, planted, found, hits, precision, recall) of labels by series, time and agent."""
    j = planted.withColumnRenamed("action", "p").join(found.withColumnRenamed("action", "f"), [*AGENT, "t"])
    p = j.groupBy(F.col("p").alias("action")).agg(F.count(F.lit(1)).alias("planted"), F.count(F.when(F.col("p") == F.col("f"), 1)).alias("hits"))
    f = j.groupBy(F.col("f").alias("action")).agg(F.count(F.lit(1)).alias("found"))
    return p.join(f, "action", "full").na.fill(0, ["planted", "found", "hits"]).select("action", "planted", "found", "hits", ratio(F.col("hits"), F.col("found"), 0.0).alias("precision"), ratio(F.col("hits"), F.col("planted"), 0.0).alias("recall"))


def minus(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    return ax - bx, ay - by


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """The vector of length 1 in the same direction, 0 for 0."""
    n = norm(x, y)
    return tuple(F.when(n > 0, c * (1 / n)).otherwise(0.0) for c in (x, y))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle of two vectors, 0 to pi."""
    c = dot(ax, ay, bx, by) / (norm(ax, ay) * norm(bx, by) + 1e-12)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def distance_matrix(df: DataFrame) -> DataFrame:
    """(series_id, t, agent_id, distances): a map of the distances to all agents of the frame, 0 to itself."""
    o = df.select(ID, "t", F.col("agent_id").alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = df.join(o, [ID, "t"])
    return j.groupBy(ID, "t", "agent_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_o", norm(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))))).alias("distances"))


def focal_context(df: DataFrame, focal: DataFrame) -> DataFrame:
    """df with fx, fy, distance and bearing to the focal point, and on_ball: whether no other agent is nearer (the smaller id on ties).

    A height that differs from the focal point's by 1e-12 of both or less, as a mean's last bits do, is the same: the bearing
    is then 0 or pi, and never -pi by the order in which the mean was summed.
    """
    dy = F.col("fy") - F.col("y")
    dy = F.when(F.abs(dy) > 1e-12 * (F.abs("fy") + F.abs("y")), dy).otherwise(0.0)
    d = focal_distances(df, focal).withColumn("bearing", F.atan2(dy, F.col("fx") - F.col("x")))
    w = Window.partitionBy(ID, "t").orderBy(F.round("distance", 9), "agent_id")
    return d.withColumn("on_ball", F.row_number().over(w) == 1)


def local_triangles(df: DataFrame, focal: DataFrame, k: int = 5, longest: float = 20.0) -> DataFrame:
    """(series_id, t, a, b, c, edge): of the k agents nearest the focal point, the four triangles of the shortest longest edge.

    Triangles with an edge over longest, or of an area under 1, are left out.
    """
    w = Window.partitionBy(ID, "t").orderBy("distance", "agent_id")
    near = focal_distances(df, focal).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    corner = lambda n: near.select(ID, "t", F.col("agent_id").alias(n), F.col("_r").alias(f"r{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    j = corner("a").join(corner("b"), [ID, "t"]).where("ra < rb").join(corner("c"), [ID, "t"]).where("rb < rc")
    side = lambda p, q: norm(F.col(f"x{p}") - F.col(f"x{q}"), F.col(f"y{p}") - F.col(f"y{q}"))
    area = F.abs((F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("yb") - F.col("ya")) * (F.col("xc") - F.col("xa")))
    j = j.withColumn("edge", F.greatest(side("a", "b"), side("b", "c"), side("c", "a"))).where((F.col("edge") <= longest) & (area >= 2.0))
    first = Window.partitionBy(ID, "t").orderBy("edge", "ra", "rb", "rc")
    return j.withColumn("_k", F.row_number().over(first)).where("_k <= 4").select(ID, "t", "a", "b", "c", "edge")


def path_windows(df: DataFrame, metres: float) -> DataFrame:
    """(series_id, agent_id, t, length, net, efficiency, mean_dev, rms_dev) of the path from each sample to the first one at
    least so many metres of way ahead; samples without one are left out.

    Deviations are from the chord, null where it is under 1e-9. A window holds the samples of that way.
    """
    if not (math.isfinite(metres) and metres > 0):
        raise ValueError("a window above 0 is needed")
    w = by_agent()
    step = F.coalesce(norm(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    d = df.select(*AGENT, "t", "x", "y", step.alias("_s")).withColumn("_c", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    way, reach = F.round(F.col("_c") * 1e6).cast("long"), int(round(metres * 1e6))
    on = Window.partitionBy(*AGENT).orderBy(way)
    here = F.struct("t", "x", "y", F.col("_c").alias("c"))
    d = d.withColumns({"_e": F.min(here).over(on.rangeBetween(reach, Window.unboundedFollowing)), "_i": F.collect_list(here).over(on.rangeBetween(0, reach - 1))}).where("_e is not null")
    inner = F.filter("_i", lambda p: (p["t"] >= F.col("t")) & (p["t"] < F.col("_e.t")))
    d = d.withColumns({"_i": F.concat(inner, F.array("_e")), "length": F.col("_e.c") - F.col("_c"), "net": norm(F.col("_e.x") - F.col("x"), F.col("_e.y") - F.col("y"))})
    off = F.transform("_i", lambda p: F.abs((p["x"] - F.col("x")) * (F.col("_e.y") - F.col("y")) - (p["y"] - F.col("y")) * (F.col("_e.x") - F.col("x"))) / F.col("net"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size("_i")
    fine = F.col("net") >= 1e-9
    return d.select(*AGENT, "t", "length", "net", F.least(F.col("net") / F.col("length"), F.lit(1.0)).alias("efficiency"), F.when(fine, total(off)).alias("mean_dev"), F.when(fine, F.sqrt(total(F.transform(off, lambda v: v * v)))).alias("rms_dev"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull from the lowest x, without points on its edges."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def polygon_area(points: np.ndarray) -> float:
    """Signed area, positive counter-clockwise."""
    x, y = np.asarray(points, float).reshape(-1, 2).T
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2) if len(x) else 0.0


def hull_areas(df: DataFrame, group: str | None = None) -> DataFrame:
    """(series_id, t, area) of the hull of each frame's agents, or of each group's."""
    keys = [ID, "t", *([group] if group else [])]
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), polygon_area(convex_hull(pdf[["x", "y"]].to_numpy()))]], columns=[*keys, "area"])

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", area double")


def markings(length: float = PITCH["length"][2], width: float = PITCH["width"][2]) -> dict:
    """Bounds, boxes, spots and goals of a pitch about the origin; sizes beyond the laws' are refused."""
    if not (PITCH["length"][0] <= length <= PITCH["length"][1] and PITCH["width"][0] <= width <= PITCH["width"][1] and length > width):
        raise ValueError("not a pitch")
    half, goal = length / 2, PITCH["goal_width"]
    box = lambda depth: (half - depth, half, -(goal / 2 + depth), goal / 2 + depth)
    return {"bounds": (-half, half, -width / 2, width / 2), "outer": box(PITCH["outer_depth"]), "inner": box(PITCH["inner_depth"]), "spot": (half - PITCH["spot"], 0.0), "goal": ((half, -goal / 2), (half, goal / 2)), "circle": PITCH["circle"]}


def generate(kind: str, n: int, dt: float, start=(0.0, 0.0), velocity=(1.0, 0.0), amplitude: float = 1.0, period: float = 5.0, noise: float = 0.0) -> pd.DataFrame:
    """t, x, y of a linear or curved path; noise is a fixed pattern of that size."""
    t = np.arange(n) * dt
    x, y = start[0] + velocity[0] * t, start[1] + velocity[1] * t
    if kind == "curved":
        y = y + amplitude * np.sin(2 * np.pi * t / period)
    k = np.arange(n)
    return pd.DataFrame({"t": t, "x": x + noise * np.sin(12.9898 * k), "y": y + noise * np.cos(78.233 * k)})
