import random

import pytest
from pyspark.sql import functions as F

from rollspan.operators import forecasts as fc
from rollspan.operators import moments as mm
from rollspan.operators.windows import window_arrays

ARRAYS = {"persistence": fc.persistence, "mean": fc.context_mean, "linear": fc.linear,
          "ar1": fc.autoregression(1), "ridge": fc.autoregression(1, 10.0)}
MOMENTS = {"persistence": mm.persistence, "mean": mm.context_mean, "linear": mm.linear,
           "ar1": mm.autoregression1(), "ridge": mm.autoregression1(10.0)}


def series(kind, n, seed):
    rng = random.Random(seed)
    if kind == "flat runs":
        return [float(i // 9) for i in range(n)]
    if kind == "far level":
        return [1e9 + rng.random() for _ in range(n)]
    if kind == "trend":
        return [1e6 * i + rng.random() for i in range(n)]
    return [rng.gauss(0, 3) for _ in range(n)]


def tables(spark, kind, n=40):
    frames = [(t, i, float(i), x, -2 * x) for s, t in enumerate("ab") for i, x in enumerate(series(kind, n, s))]
    frames = spark.createDataFrame(frames, "trajectory_id string, frame long, time double, v double, w double")
    index = [(t, s, c, h) for t in "ab" for c, h in ((3, 2), (5, 1), (8, 3)) for s in range(n - c - h + 1)]
    index = spark.createDataFrame(index, "trajectory_id string, start long, context_frames int, horizon_frames int")
    return frames, index


def collected(rows):
    return {
        (r["trajectory_id"], r["start"], r["context_frames"], r["feature_id"], r["model"]): r for r in rows.collect()
    }


@pytest.mark.parametrize("kind", ["noise", "flat runs", "far level", "trend"])
@pytest.mark.parametrize("chunk", [8, 11])
def test_moments_forecast_like_whole_contexts(spark, short_blocks, kind, chunk):
    frames, index = tables(spark, kind)
    want = collected(fc.forecast(window_arrays(frames, index, ["v", "w"], 11), ARRAYS))
    got = collected(mm.forecast(mm.context_moments(frames, index, ["v", "w"], chunk, 11), MOMENTS))
    assert got.keys() == want.keys() and len(got) == 2 * 2 * 5 * (36 + 35 + 30)
    for key, row in got.items():
        assert row["target"] == want[key]["target"] and row["origin"] == want[key]["origin"]
        size = 1e-7 if kind == "far level" else 1e-9
        assert row["points"] == pytest.approx(want[key]["points"], rel=size, abs=1e-9), key


def test_no_context_is_carried(spark):
    frames, index = tables(spark, "noise")
    rows = mm.context_moments(frames, index, ["v"], 8, 11)
    assert "context" not in rows.columns
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice") == 1  # the targets


def test_a_window_costs_the_same_in_any_block(spark):
    """Entries are taken by place in generated code.

    A lambda over a block's arrays would have them copied for every window of the block.
    """
    frames, index = tables(spark, "noise")
    rows = mm.context_moments(frames, index, ["v", "w"], 8, 11)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_every_model_is_worked_out_once(spark):
    frames, index = tables(spark, "noise")
    rows = mm.context_moments(frames, index, ["v"], 8, 11)
    out = mm.forecast(rows, {"persistence": mm.persistence, "linear": mm.linear})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and plan.count("array_repeat") == 1
    assert out.count() == 2 * rows.count()


def test_short_contexts_and_long_ones_are_refused(spark):
    frames, _ = tables(spark, "noise")
    one = spark.createDataFrame([("a", 0, 1, 1)], "trajectory_id string, start long, context_frames int, horizon_frames int")
    rows = mm.context_moments(frames, one, ["v"], 8, 11)
    assert len(mm.forecast(rows, {"mean": mm.context_mean}).collect()) == 1
    for model in (mm.linear, mm.autoregression1()):
        with pytest.raises(Exception, match="observed frames"):
            mm.forecast(rows, {"m": model}).collect()
    with pytest.raises(Exception, match="longer than the chunk"):
        mm.context_moments(frames, one.withColumn("context_frames", F.lit(9)), ["v"], 8, 11).collect()
