"""A work log of queries, attempts and artifacts as an append-only table of actions; what holds now is derived from it.

An action is taken if its own fields are right and what it refers to was taken before it. Rows may come again: of rows of one
seq one counts. Nothing is updated in place, so a lost executor costs a rerun and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.plans.stored import stored

#: The columns of a log. id: of what is opened, started, finished or attached to; of: the query of an attempt; parent: the
#: query or attempt that it belongs under; text: title, summary or path; state: status, kind, outcome or role.
LOG = "seq long, at timestamp, action string, id string, of string, parent string, agent string, state string, text string, sha256 string"
# States of each action.
STATUSES, KINDS, OUTCOMES, ROLES = ["done", "abandoned"], ["session", "spawn", "revise"], ["succeeded", "failed", "superseded", "refused"], ["input", "output", "log"]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def own_fault(log: DataFrame) -> Column:
    """Why an action is refused for its own fields; null if it isn't."""
    is_ = lambda a: F.col("action") == a
    other = lambda states: ~F.coalesce(F.col("state").isin(states), F.lit(False))
    odd_hash = F.col("sha256").isNotNull() & ~F.col("sha256").rlike("^[0-9A-Fa-f]{64}$")
    path = F.replace(F.col("text"), F.lit("\\"), F.lit("/"))
    away = F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")
    return (
        F.when(~F.coalesce(F.col("action").isin("open_query", "finish_query", "start_attempt", "finish_attempt", "add_artifact"), F.lit(False)), "unknown action")
        .when(F.col("id").isNull(), "id is required")
        .when(is_("open_query") & _blank("text"), "title is required")
        .when(is_("finish_query") & other(STATUSES), "query status must be done or abandoned")
        .when(is_("start_attempt") & _blank("agent"), "agent is required")
        .when(is_("start_attempt") & F.col("state").isNotNull() & other(KINDS), "unknown kind")
        .when(is_("finish_attempt") & other(OUTCOMES), "unknown outcome")
        .when(is_("finish_attempt") & _blank("text"), "summary is required")
        .when(is_("add_artifact") & other(ROLES), "unknown artifact role")
        .when(is_("add_artifact") & _blank("text"), "path is required")
        .when(is_("add_artifact") & away, "path must be relative and must not contain '..'")
        .when(odd_hash, "sha256 must be 64 hex digits")
    )


def judged(log: DataFrame) -> DataFrame:
    """log, a row for each seq, with fault: why an action was refused, null if it was taken.

    An id belongs to the first action that opens or starts it with right fields; later ones of the same id are refused.
    Finishing again overwrites what was before. A refused query or attempt refuses what refers to it. Queries and then
    attempts are judged among themselves, and every action looks up the one that its id names. The log is kept in Spark's
    cache meanwhile.
    """
    once = log.withColumn("_r", F.row_number().over(Window.partitionBy("seq").orderBy(F.hash(*log.columns), *[c for c in log.columns if c != "seq"]))).where("_r = 1").drop("_r")
    d = once.withColumn("fault", own_fault(once)).persist()
    q, a = _owners(d, "open_query"), _owners(d, "start_attempt")

    up = q.select(F.col("id").alias("_u"), F.col("seq").alias("_useq"))
    j = q.join(up, (F.col("parent") == F.col("_u")) & (F.col("_useq") < F.col("seq")), "left")
    lost = F.col("parent").isNotNull() & F.col("_u").isNull()
    q = _closed(j.select("id", "seq", F.when(lost, "parent query not found").alias("why"), lost.alias("bad"), F.col("_u").alias("up")))

    of = q.select(F.col("id").alias("_q"), F.col("seq").alias("_qseq"), F.col("bad").alias("_qbad"))
    up = a.select(F.col("id").alias("_u"), F.col("seq").alias("_useq"), F.col("of").alias("_uof"))
    j = a.join(of, (F.col("of") == F.col("_q")) & (F.col("_qseq") < F.col("seq")), "left").join(up, (F.col("parent") == F.col("_u")) & (F.col("_useq") < F.col("seq")), "left")
    why = F.when(F.col("_q").isNull(), "query not found").when(F.col("parent").isNotNull() & F.col("_u").isNull(), "parent attempt not found").when(F.col("_uof") != F.col("of"), "parent attempt belongs to a different query")
    j = j.withColumn("why", why)
    a = _closed(j.select("id", "seq", "why", (F.col("why").isNotNull() | F.col("_qbad")).alias("bad"), F.col("_u").alias("up")))

    made = q.withColumn("_k", F.lit("query")).unionByName(a.withColumn("_k", F.lit("attempt"))).select("_k", F.col("id").alias("_id"), F.col("seq").alias("_seq"), "why", "bad")
    makes, kind = F.col("action").isin("open_query", "start_attempt"), F.when(F.col("action").isin("open_query", "finish_query"), "query").otherwise("attempt")
    fine = d.where("fault is null").drop("fault").withColumn("_kind", kind)
    found = fine.join(made, (F.col("_kind") == F.col("_k")) & (F.col("id") == F.col("_id")), "left")
    there = F.coalesce(F.col("_seq") < F.col("seq"), F.lit(False))
    refused = F.when(F.col("bad"), "what it refers to was refused")
    fault = F.when(makes, F.when(there, "id is there already").otherwise(F.coalesce("why", refused))).when(~there, F.concat("_kind", F.lit(" not found"))).otherwise(refused)
    return found.select(*log.columns, fault.alias("fault")).unionByName(d.where("fault is not null"))


def _owners(d: DataFrame, action: str) -> DataFrame:
    """(id, seq, of, parent) of the first of the actions of each id whose own fields are right."""
    return d.where((F.col("action") == action) & F.col("fault").isNull()).groupBy("id").agg(F.min(F.struct("seq", "of", "parent")).alias("_m")).select("id", "_m.*")


def _closed(nodes: DataFrame) -> DataFrame:
    """nodes (id, seq, why, bad, up) without up, bad also where any node on the chain of ups is.

    Each round looks twice as far up a chain, so that their number is the logarithm of the longest one's length, and writes
    a table, so that no plan holds more than one round. An up has a smaller seq than what is under it.
    """
    t = stored(nodes)
    while not (active := t.where("up is not null and not bad")).isEmpty():
        above = t.select(F.col("id").alias("_u"), F.col("bad").alias("_bad"), F.col("up").alias("_up"))
        next_ = active.join(above, F.col("up") == F.col("_u")).select("id", "seq", "why", F.col("_bad").alias("bad"), F.col("_up").alias("up"))
        t = stored(t.where("up is null or bad").unionByName(next_))
    return t.drop("up")


def _last(actions: DataFrame, *columns: str) -> DataFrame:
    """The last of the actions of each id."""
    return actions.groupBy("id").agg(*[F.max_by(c, "seq").alias(n) for c, n in zip(columns[::2], columns[1::2], strict=True)])


def queries(judged_: DataFrame) -> DataFrame:
    """(id, parent_id, title, agent, status, opened_at, updated_at): open until it was finished, by the last action."""
    t = judged_.where("fault is null")
    o = t.where("action = 'open_query'").select("id", F.col("parent").alias("parent_id"), F.col("text").alias("title"), "agent", F.col("at").alias("opened_at"))
    f = _last(t.where("action = 'finish_query'"), "state", "status", "at", "updated_at")
    return o.join(f, "id", "left").select("id", "parent_id", "title", "agent", F.coalesce("status", F.lit("open")).alias("status"), "opened_at", F.coalesce("updated_at", "opened_at").alias("updated_at"))


def attempts(judged_: DataFrame) -> DataFrame:
    """(id, query_id, parent_id, agent, kind, outcome, summary, started_at, finished_at): in_progress until finished."""
    t = judged_.where("fault is null")
    o = t.where("action = 'start_attempt'").select("id", F.col("of").alias("query_id"), F.col("parent").alias("parent_id"), "agent", F.coalesce("state", F.lit("session")).alias("kind"), F.col("at").alias("started_at"))
    f = _last(t.where("action = 'finish_attempt'"), "state", "outcome", "text", "summary", "at", "finished_at")
    return o.join(f, "id", "left").select("id", "query_id", "parent_id", "agent", "kind", F.coalesce("outcome", F.lit("in_progress")).alias("outcome"), "summary", "started_at", "finished_at")


def artifacts(judged_: DataFrame) -> DataFrame:
    """(id, attempt_id, path, role, sha256, at), numbered by the action that attached it."""
    return judged_.where("fault is null and action = 'add_artifact'").select(F.col("seq").alias("id"), F.col("id").alias("attempt_id"), F.col("text").alias("path"), F.col("state").alias("role"), "sha256", "at")


def status(judged_: DataFrame) -> DataFrame:
    """(what, state, n): how many queries of each status, attempts of each outcome, artifacts of each role and refused actions."""
    parts = [queries(judged_).select(F.lit("query").alias("what"), F.col("status").alias("state")), attempts(judged_).select(F.lit("attempt"), "outcome"), artifacts(judged_).select(F.lit("artifact"), "role"), judged_.where("fault is not null").select(F.lit("refused"), "fault")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("what", "state").agg(F.count(F.lit(1)).alias("n"))
