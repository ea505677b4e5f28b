"""The work log against a store that takes actions one after another."""

import datetime
import random

import pytest

from tidewave.operators import worklog

T0 = datetime.datetime(2024, 1, 1)


def act(seq, action, id_, of=None, parent=None, agent=None, state=None, text=None, sha=None):
    return (seq, T0 + datetime.timedelta(seconds=seq), action, id_, of, parent, agent, state, text, sha)


def plain(log):
    """(faults by seq, queries, attempts, artifacts), an action at a time."""
    queries, attempts, artifacts, faults, claimed = {}, {}, {}, {}, set()
    seen = set()
    for seq, _, action, i, of, parent, agent, state, text, sha in sorted(log, key=lambda r: r[0]):
        if seq in seen:
            continue
        seen.add(seq)
        blank = lambda s: not (s or "").strip()
        ok_hash = sha is None or len(sha) == 64 and all(c in "0123456789abcdefABCDEF" for c in sha)
        bad = True
        if action == "open_query":
            own = i is None or blank(text) or not ok_hash
            bad = own or ("q", i) in claimed or (parent is not None and parent not in queries)
            claimed |= set() if own else {("q", i)}
            if not bad:
                queries[i] = [parent, text, "open"]
        elif action == "finish_query":
            bad = state not in worklog.STATUSES or i not in queries or not ok_hash
            if not bad:
                queries[i][2] = state
        elif action == "start_attempt":
            own = i is None or blank(agent) or (state is not None and state not in worklog.KINDS) or not ok_hash
            bad = own or ("a", i) in claimed or of not in queries or (parent is not None and (parent not in attempts or attempts[parent][0] != of))
            claimed |= set() if own else {("a", i)}
            if not bad:
                attempts[i] = [of, parent, state or "session", "in_progress", None]
        elif action == "finish_attempt":
            bad = state not in worklog.OUTCOMES or blank(text) or i not in attempts or not ok_hash
            if not bad:
                attempts[i][3:] = [state, text]
        elif action == "add_artifact":
            bad = state not in worklog.ROLES or blank(text) or text.startswith("/") or ".." in text.split("/") or i not in attempts or not ok_hash
            if not bad:
                artifacts[seq] = (i, text, state)
        faults[seq] = bad
    return faults, queries, attempts, artifacts


def check(spark, log):
    j = worklog.judged(spark.createDataFrame(log, worklog.LOG).repartition(3)).persist()
    faults, queries, attempts, artifacts = plain(log)
    assert {r.seq: r.fault is not None for r in j.collect()} == faults
    assert {r.id: [r.parent_id, r.title, r.status] for r in worklog.queries(j).collect()} == queries
    assert {r.id: [r.query_id, r.parent_id, r.kind, r.outcome, r.summary] for r in worklog.attempts(j).collect()} == attempts
    assert {r.id: (r.attempt_id, r.path, r.role) for r in worklog.artifacts(j).collect()} == artifacts
    counts = {(r.what, r.state): r.n for r in worklog.status(j).collect()}
    assert sum(n for (w, _), n in counts.items() if w == "refused") == sum(faults.values())
    return j


def test_each_rule(spark):
    log = [
        act(1, "open_query", "q1", text="one"),
        act(2, "open_query", "q2", parent="q1", text="two", sha="a" * 64),
        act(3, "open_query", "q3", parent="q9", text="no parent"),
        act(4, "open_query", "q4", parent="q3", text="under a refused one"),
        act(5, "open_query", "q5", parent="q4", text="and under that"),
        act(6, "open_query", "q6", text="  "),
        act(7, "open_query", "q7", text="x", sha="zz"),
        act(8, "finish_query", "q1", state="done"),
        act(9, "finish_query", "q1", state="abandoned"),
        act(10, "finish_query", "q2", state="open"),
        act(11, "finish_query", "q5", state="done"),
        act(12, "start_attempt", "a1", of="q1", agent="x"),
        act(13, "start_attempt", "a2", of="q2", agent="x", state="spawn", parent="a1"),
        act(14, "start_attempt", "a3", of="q1", agent="x", state="revise", parent="a1"),
        act(15, "start_attempt", "a4", of="q1", agent=""),
        act(16, "start_attempt", "a5", of="q1", agent="x", state="odd"),
        act(17, "start_attempt", "a6", of="q4", agent="x"),
        act(18, "finish_attempt", "a1", state="succeeded", text="fine"),
        act(19, "finish_attempt", "a3", state="failed", text=" "),
        act(20, "finish_attempt", "a6", state="failed", text="gone"),
        act(21, "add_artifact", "a1", state="output", text="out/x.txt"),
        act(22, "add_artifact", "a1", state="output", text="../x.txt"),
        act(23, "add_artifact", "a1", state="output", text="/x.txt"),
        act(24, "add_artifact", "a1", state="none", text="x"),
        act(25, "open_query", "q1", text="again"),
        act(26, "finish_attempt", "a9", state="failed", text="early"),
        act(27, "start_attempt", "a9", of="q1", agent="x"),
        act(28, "burn", "q1"),
        act(28, "burn", "q1"),
        act(29, "start_attempt", "a7", agent="x"),
        act(30, "open_query", None, text="nameless"),
    ]
    j = check(spark, log)
    told = {r.seq: r.fault for r in j.collect()}
    assert told[3] == "parent query not found" and told[4] == told[5] == told[17] == told[11] == "what it refers to was refused" and told[13] == "parent attempt belongs to a different query" and told[25] == "id is there already"
    assert worklog.judged(spark.createDataFrame([], worklog.LOG)).count() == 0


@pytest.mark.parametrize("seed", [2])
def test_any_log(spark, seed):
    r = random.Random(seed)
    name = lambda k: r.choice([f"{k}{r.randrange(25)}", f"{k}{r.randrange(25)}", None]) if r.random() < 0.3 else f"{k}{r.randrange(25)}"
    log = []
    for seq in range(150):
        a = r.choice(["open_query", "open_query", "finish_query", "start_attempt", "start_attempt", "finish_attempt", "add_artifact"])
        k = "q" if "query" in a else "a"
        states = {"finish_query": worklog.STATUSES, "start_attempt": worklog.KINDS, "finish_attempt": worklog.OUTCOMES, "add_artifact": worklog.ROLES}.get(a, [None])
        log.append(act(seq, a, name(k), of=name("q"), parent=r.choice([None, name(k)]), agent=r.choice(["x", "x", ""]), state=r.choice([*states, *states, "odd"]), text=r.choice(["t", "t/u", "t", ""]), sha=r.choice([None, None, "b" * 64, "c"])))
    check(spark, log)


def test_long_chains_of_parents(spark):
    n = 300
    log = [act(k, "open_query", f"q{k}", parent=f"q{k - 1}" if k else "none", text="t") for k in range(n)]
    log += [act(n + k, "open_query", f"r{k}", parent=f"r{k - 1}" if k else None, text="t") for k in range(n)]
    log += [act(3 * n + k, "start_attempt", f"a{k}", of="r0", parent=f"a{k - 1}" if k else None, agent="x") for k in range(n)]
    log += [act(4 * n + k, "start_attempt", f"b{k}", of="q5" if k == 7 else "r0", parent=f"b{k - 1}" if k else None, agent="x") for k in range(n)]
    check(spark, log)
