"""Steps that must not grow faster than their input."""

import numpy as np
import pyarrow as pa

from tidewave.operators import classification, probabilities, spatial


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_agent_makes_no_pairs(spark):
    d = spark.createDataFrame([("a", 0.0, k, float(x), 0.0) for k, x in enumerate((0, 1, 3))] + [("a", 1.0, 0, 0.0, 0.0)], "series_id string, t double, agent_id long, x double, y double")
    got = spatial.nearest_agent(d)
    assert "Join" not in plan(got)
    assert {r.agent_id: (r.nearest, r.distance, r.free_space) for r in got.collect()} == {0: (1, 1, 2), 1: (0, 1, 1.5), 2: (1, 2, 2.5)}


def test_exponentials_of_probabilities_are_taken_once(spark):
    d = spark.createDataFrame([(k, float(k % 7), k % 3) for k in range(30)], "i long, x double, y int")
    got = probabilities.nb_proba(d, classification.gaussian_nb(d, ["x"], "y"), ["x"], ["i"])
    assert plan(got).count("EXP(") == 3
    assert got.groupBy("i").agg({"p": "sum"}).where("abs(`sum(p)` - 1) > 1e-12").count() == 0


def test_vectors_are_packed_in_blocks():
    x = np.arange(12.0).reshape(4, 3)
    (b,) = classification._packed([pa.RecordBatch.from_pydict({"v": pa.array(x.tolist())})])
    assert b.column(0).to_pylist() == [4] and b.column(1).to_pylist() == [x.tobytes()]
