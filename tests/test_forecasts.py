import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollspan.operators import diagnostics as dg
from rollspan.operators import forecasts as fc
from rollspan.operators import inference as inf
from rollspan.operators import losses as ls
from rollspan.operators import nlinear as nl
from rollspan.operators import residuals as rs
from rollspan.operators import windows as wn
from tests import data
from tests.least_squares import continued

POLICY = inf.Policy(seed=1, samples=200, min_groups=2, min_tail=1)


def test_first_window_points(spark):
    context = [float(t) for t in range(6)]
    arrays = data.arrays(spark, (context, [6, 7]))
    models = {
        "persistence": fc.persistence, "mean": fc.context_mean, "linear": fc.linear,
        "ar1": fc.autoregression(1), "ar2": fc.autoregression(2, 0.0),
    }
    out = {r["model"]: r["points"] for r in fc.forecast(arrays, models).collect()}
    assert out["persistence"] == [5, 5]
    assert out["mean"] == [2.5, 2.5]
    for name in ("linear", "ar1", "ar2"):
        assert out[name] == pytest.approx([6, 7])


@pytest.mark.parametrize("ridge", [0.0, 1.0, 10.0])
def test_autoregression_matches_least_squares(spark, ridge):
    rng = np.random.default_rng(2)
    series = [list(rng.normal(size=9).round(3)) for _ in range(3)] + [[0.3] * 9, [0.0] * 9]
    arrays = data.arrays(spark, *[(s, [0.0] * 4) for s in series])
    for lags in (1, 2):
        out = fc.forecast(arrays, {"ar": fc.autoregression(lags, ridge)})
        got = {r["trajectory_id"]: r["points"] for r in out.collect()}
        for i, s in enumerate(series):
            assert got[f"t{i}"] == pytest.approx(
                continued(pd.DataFrame(s), lags, ridge, 4)[:, 0], abs=1e-9
            )


def test_vector_autoregression_recovers_a_lead(spark):
    a = [1.0, 4.0, 2.0, 6.0, 3.0, 8.0, 5.0, 9.0, 1.0]
    b = [0.0, *a[:-1]]
    rows = [("t0", 0, 9, 1, "s", "g", [("b", b, [a[-1]]), ("a", a, [0.0])])]
    channels = spark.createDataFrame(
        rows,
        "trajectory_id string, start long, context_frames int, horizon_frames int, "
        "system_id string, group_id string, "
        "channels array<struct<feature_id: string, context: array<double>, target: array<double>>>",
    )
    out = fc.predictions(fc.forecast_channels(channels, {"var1": fc.vector_autoregression(1)}))
    got = {r["feature_id"]: r["point"] for r in out.collect()}
    assert got["b"] == pytest.approx(a[-1])


def test_too_short_contexts_fail(spark):
    arrays = data.arrays(spark, ([1.0, 2.0], [3.0]))
    with pytest.raises(Exception):
        fc.forecast(arrays, {"ar": fc.autoregression(1)}).collect()
    with pytest.raises(Exception):
        fc.forecast(data.arrays(spark, ([1.0], [3.0])), {"l": fc.linear}).collect()


def pred_rows(spark, rows):
    ddl = (
        "model string, trajectory_id string, start long, context_frames int, horizon_frames int, "
        "system_id string, group_id string, step int, feature_id string, target_frame long, "
        "origin double, point double, target double, levels array<double>, "
        "quantiles array<double>"
    )
    return spark.createDataFrame(rows, ddl)


def hand(spark):
    levels = [0.1, 0.5, 0.9]
    return pred_rows(
        spark,
        [
            ("m", "t", 0, 1, 2, "s", "g", 1, "x", 1, 0.0, 3.0, 0.0, levels, [-1.0, 0.0, 1.0]),
            ("m", "t", 0, 1, 2, "s", "g", 2, "x", 2, 0.0, 4.0, 0.0, levels, [1.0, 2.0, 3.0]),
        ],
    )


def scaler(spark, scale=2.0):
    return spark.createDataFrame([("x", 0.0, scale)], "feature_id string, center double, scale double")


def test_hand_losses(spark):
    rows = ls.losses(hand(spark), scaler(spark), (0.1, 0.5, 0.9), ((0.1, 0.9),))
    whole = ls.with_step0(rows).filter("step = 0").first()
    assert (whole["mae"], whole["rmse"], whole["scaled-mae"]) == (3.5, 12.5, 1.75)
    assert whole["pinball-0.1-0.1"] == pytest.approx(0.5)
    assert whole["pinball-0.5-0.5"] == pytest.approx(0.5)
    assert (whole["coverage-0.1-0.9"], whole["width-0.1-0.9"]) == (0.5, 2.0)
    metrics = ls.hierarchy(rows)
    rmse = metrics.filter("level = 'aggregate' and metric = 'rmse' and step = 0").first()["value"]
    assert rmse == pytest.approx(math.sqrt(12.5))


def test_crossing_quantiles(spark):
    crossed = hand(spark).withColumn(
        "quantiles", F.when(F.col("step") == 2, F.array(F.lit(2.0), F.lit(1.0), F.lit(3.0)))
        .otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))
    )
    with pytest.raises(Exception):
        ls.losses(crossed, scaler(spark), (0.1, 0.5, 0.9), ((0.1, 0.9),)).collect()
    tagged = dg.tag_crossings(crossed)
    assert [r["quantiles_valid"] for r in tagged.orderBy("step").collect()] == [True, False]
    status = dg.crossing_status(tagged).first()
    assert (status["crossing_points"], status["affected_windows"], status["valid"]) == (1, 1, False)
    leads = dg.lead_table(tagged, (0.1, 0.5, 0.9), ((0.1, 0.9),)).collect()
    assert len(leads) == 2 and all(r["coverage-0.1-0.9"] is None for r in leads)


def test_residual_quantiles(spark):
    table = data.trajectories(spark, frames=12)
    frames = data.frames(spark, lambda i, t: t + 100 * i, length=12)
    grid = wn.Grid((6,), (2,), 1)
    index = wn.windows(table, data.assignments(table), grid)
    arrays = wn.window_arrays(frames, index, ["position", "constant"], grid.span)
    rows = fc.predictions(fc.forecast(arrays, {"persistence": fc.persistence}))
    train = rows.filter("split = 'train'")
    fitted = rs.fit_residual_quantiles(train, [0.1, 0.5, 0.9])
    got = {(r["feature_id"], r["step"]): r["offsets"] for r in fitted.collect()}
    assert got[("position", 1)] == [0, 0, 1] and got[("position", 2)] == [0, 0, 2]
    assert got[("constant", 1)] == [0, 0, 0]
    out = rs.apply_residuals(rows, fitted).filter("feature_id = 'position' and step = 2").first()
    assert out["quantiles"] == [out["point"], out["point"], out["point"] + 2]


def test_train_benchmark_numbers(spark):
    table = data.trajectories(spark, frames=12)
    frames = data.frames(spark, lambda i, t: 100 * i + t * (1 + i / 4), length=12)
    grid = wn.Grid((6,), (2,), 1)
    index = wn.windows(table, data.assignments(table), grid, "train")
    assert index.count() == 15
    arrays = wn.window_arrays(frames, index, ["position", "constant"], grid.span)
    rows = fc.predictions(fc.forecast(arrays, {"persistence": fc.persistence}))
    units = spark.createDataFrame([("position", 1.0), ("constant", 1.0)], "feature_id string, scale double")
    metrics = ls.hierarchy(ls.losses(rows, units)).filter(
        "level = 'aggregate' and feature_id = 'position' and step = 0"
    )
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    assert got["mae"] == pytest.approx(1.875)
    assert got["rmse"] == pytest.approx(math.sqrt(2.5) * 1.25)


def test_nlinear_matches_direct_least_squares(spark):
    rng = np.random.default_rng(0)
    series = [rng.normal(size=7) for _ in range(40)]
    arrays = data.arrays(spark, *[(s[:5], s[5:]) for s in series]).repartition(3)
    flat = scaler(spark, 2.0)
    context = np.array([s[:5] for s in series]) / 2
    target = np.array([s[5:] for s in series]) / 2
    last = context[:, -1:]
    design = np.hstack([context - last, np.ones((40, 1))])
    weights = nl.fit_nlinear(arrays, flat, 5, 2, (0.0, 3.0))
    for ridge in (0.0, 3.0):
        penalty = np.sqrt(ridge) * np.diag([1.0] * 5 + [0.0])
        want = np.linalg.lstsq(
            np.vstack([design, penalty]), np.vstack([target - last, np.zeros((6, 2))]), rcond=None
        )[0]
        rows = weights.filter(F.col("ridge") == ridge).orderBy("step").collect()
        assert np.allclose(np.array([r["weights"] for r in rows]).T, want, atol=1e-10)
        points = nl.predict_nlinear(arrays, flat, weights.filter(F.col("ridge") == ridge))
        got = {r["trajectory_id"]: r["points"] for r in points.collect()}
        expected = (design @ want + last) * 2
        assert all(np.allclose(got[f"t{i}"], expected[i]) for i in range(40))
    facts = nl.conditioning(nl.design_factors(arrays, flat, 5, 2), 5, 2, (None, 1.0)).collect()
    by = {r["ridge"]: r for r in facts}
    assert by[None]["rank"] == 5 and by[None]["condition_number"] is None
    assert by[1.0]["rank"] == 6 and by[None]["parameters"] == 12 and by[None]["rows"] == 40


def test_group_intervals(spark):
    values = spark.createDataFrame(
        [(1, 1, "s", "a", -2.0), (1, 1, "s", "b", -2.0)],
        "context_frames int, horizon_frames int, series string, group_id string, value double",
    )
    row = inf.bootstrap_ci(values, ["series"], POLICY).first()
    assert (row["marginal_lower"], row["marginal_upper"]) == (-2, -2)
    lone = inf.bootstrap_ci(values.filter("group_id = 'a'"), ["series"], POLICY).first()
    assert lone["marginal_lower"] is None and lone["marginal_status"] == "insufficient-groups"
    strict = inf.Policy(seed=1, samples=200, min_groups=2, min_tail=10)
    fine = inf.bootstrap_ci(values, ["series"], strict).first()
    assert fine["marginal_status"] == "insufficient-bootstrap-resolution"
    with pytest.raises(Exception):
        inf.bootstrap_ci(
            values.unionByName(values.limit(1).withColumn("series", F.lit("other"))), ["series"], POLICY
        ).collect()


def test_unpaired_groups_fail(spark):
    ddl = "context_frames int, horizon_frames int, step int, group_id string, value double"
    left = spark.createDataFrame([(1, 1, 1, "a", 1.0), (1, 1, 1, "b", 2.0)], ddl)
    right = spark.createDataFrame([(1, 1, 1, "a", 1.0)], ddl)
    with pytest.raises(Exception):
        inf.paired_effects(left, right, POLICY).collect()


def test_lead_table_for_decisions(spark):
    rows = [
        ("m", 1, 2, "x", "a", "a1", 0.0, 0.0, 0.0), ("m", 1, 2, "x", "a", "a1", 2.0, 4.0, 2.0),
        ("m", 1, 2, "x", "a", "a2", 5.0, 25.0, 5.0), ("m", 1, 2, "x", "b", "b1", 9.0, 81.0, 9.0),
    ]
    leads = spark.createDataFrame(
        rows,
        "model string, context_frames int, horizon_frames int, feature_id string, group_id string, "
        "trajectory_id string, lead_absolute_error double, lead_squared_error double, "
        "lead_bias double",
    ).withColumn("coverage-0.1-0.9", F.when(F.col("group_id") == "b", 1.0).otherwise(
        F.when(F.col("trajectory_id") == "a2", 1.0).otherwise(0.0)))
    got = {r["group_id"]: r for r in dg.system_metrics(leads).collect()}
    assert (got["a"]["mae"], got["b"]["mae"]) == (3, 9)
    assert got["a"]["rmse"] == pytest.approx((math.sqrt(2) + 5) / 2) and got["b"]["rmse"] == 9
    assert (got["a"]["coverage-0.1-0.9"], got["b"]["coverage-0.1-0.9"]) == (0.5, 1)


def test_decision_needs_every_bound(spark):
    good = [(k, r, -2.0, -1.0) for k in ("mae", "worthwhile", "pinball")
            for r in ("persistence", "selected-statistic")]
    good += [("worthwhile", "compact", -2.0, -1.0), ("width", "selected-statistic", -1.0, 0.0),
             ("coverage", "none", 0.75, 0.85)]
    ddl = "kind string, reference string, ci_lower double, ci_upper double"

    def decide(rows):
        return dg.decide(
            spark.createDataFrame(rows, ddl).withColumn("feature_id", F.lit("x")), 0.8, 0.1
        ).first()

    assert decide(good)["useful_minimum"] and decide(good)["useful_stronger"]
    for i in range(len(good)):
        worse = [(*g[:2], None, None) if i == j else g for j, g in enumerate(good)]
        assert not decide(worse)["useful_stronger"]
        assert decide(worse)["useful_minimum"] == (good[i][1] == "compact")


def test_diagnostics_of_constant_truth(spark):
    arrays = data.arrays(spark, ([0.3, 0.3], [0.3, 0.3, 0.3]))
    out = dg.forecast_diagnostics(fc.forecast(arrays, {"p": fc.persistence})).first()
    assert out["actual_std"] == 0 and out["spread_ratio"] is None and out["mae"] == 0


def test_normalized_score(spark):
    rows = spark.createDataFrame(
        [("m", 1, 1, "x", "a", 2.0), ("m", 1, 1, "y", "a", 8.0),
         ("m", 1, 1, "x", "b", 6.0), ("m", 1, 1, "y", "b", 0.0)],
        "model string, context_frames int, horizon_frames int, feature_id string, "
        "group_id string, mae double",
    )
    scales = spark.createDataFrame([("x", 2.0), ("y", 4.0)], "feature_id string, scale double")
    assert ls.normalized_score(rows, scales).first()["score"] == 1.5


def _one_prediction(spark, point, feature="value"):
    keys = ", ".join(f"{k} string" for k in ("model", "trajectory_id", "system_id", "group_id", "feature_id"))
    rows = [("m", "t", "s", "g", feature, 0, 4, 2, 1, point, 0.0)]
    return spark.createDataFrame(
        rows,
        f"{keys}, start long, context_frames int, horizon_frames int, step int, point double, target double",
    )


@pytest.mark.parametrize(
    "point, feature, scale, message",
    [
        (1e200, "value", 1.0, "not a finite number"),
        (1.0, "value", 0.0, "not finite and positive"),
        (1.0, "value", -1.0, "not finite and positive"),
        (1.0, "other", 1.0, "no scale"),
    ],
)
def test_losses_refuse_unfit_rows(spark, point, feature, scale, message):
    scaler = spark.createDataFrame([("value", scale)], "feature_id string, scale double")
    with pytest.raises(Exception, match=message):
        ls.losses(_one_prediction(spark, point, feature), scaler).collect()


def test_residuals_refuse_a_prediction_without_offsets(spark):
    offsets = spark.createDataFrame(
        [("m", 4, 2, 1, "value", [0.5], [0.0])],
        "model string, context_frames int, horizon_frames int, step int, feature_id string, "
        "levels array<double>, offsets array<double>",
    )
    assert rs.apply_residuals(_one_prediction(spark, 1.0), offsets).first()["quantiles"] == [1.0]
    with pytest.raises(Exception, match="no residual offsets"):
        rs.apply_residuals(_one_prediction(spark, 1.0, "other"), offsets).collect()


def test_comparison_refuses_a_missing_group(spark):
    rows = [(m, 4, 2, "value", 1, g, v) for m, g, v in
            [("a", "g1", 1.0), ("a", "g2", 2.0), ("b", "g1", 1.5), ("b", "g2", 1.0), ("c", "g1", 1.0)]]
    table = spark.createDataFrame(
        rows, "model string, context_frames int, horizon_frames int, feature_id string, step int, group_id string, value double"
    )
    with pytest.raises(Exception, match="not those of the reference"):
        inf.compare(table, "a", POLICY).collect()
    effects = inf.compare(table.filter("model != 'c'"), "a", POLICY)
    assert {r["model"]: r["mae_difference"] for r in effects.collect()} == {"a": 0.0, "b": -0.25}
    assert "CartesianProduct" not in effects._jdf.queryExecution().executedPlan().toString()


def test_broadcast_of_a_declared_table_is_bounded(spark):
    from rollspan.functions.checked import bounded

    assert bounded(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        bounded(spark.range(5), 4).collect()


def test_group_errors_of_windows_are_those_of_their_rows(spark):
    """Sums per window give the group table without a row per lead."""
    arrays = data.arrays(spark, ([0.0, 1, 2], [3.0, 9.0]), ([4.0, 2, 1], [5.0, 6.0]), ([1.0, 1, 1], [2.0, 7.0]))
    points = fc.forecast(arrays, {"persistence": fc.persistence, "linear": fc.linear})
    gap = F.when(F.col("trajectory_id") == "t2", F.array(F.lit(2.0), F.lit(None).cast("double"))).otherwise(F.col("target"))
    for given in (points, points.withColumn("target", gap)):
        order = lambda df: sorted(tuple(r) for r in df.collect())
        got, want = order(ls.group_mae_of_windows(given)), order(ls.group_mae(fc.predictions(given)))
        assert [r[:-3] + r[-2:] for r in got] == [r[:-3] + r[-2:] for r in want]
        assert [r[-3] for r in got] == pytest.approx([r[-3] for r in want])
    plan = ls.group_mae_of_windows(points)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    broken = points.withColumn("points", F.array(F.lit(float("nan")), F.lit(1.0)))
    with pytest.raises(Exception, match="not finite"):
        ls.group_mae_of_windows(broken).collect()


def test_outside_forecasts_are_read_without_a_join(spark):
    from rollspan.plans.catalog import QUERIES

    out = QUERIES["s17_external_forecasts"](spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0


def test_points_are_stored_once_per_window(spark):
    """Rows made from the stored sets are those of the models; no row per lead is written."""
    from rollspan.operators import moments as mm
    from rollspan.plans import forecast_queries as fq

    folder, models = "/root/testdata/sf0.001", ["persistence", "linear"]
    sets = fq.point_sets(spark, folder, models)
    direct = fc.predictions(fq.points(spark, folder, models))
    got = fq.rows(spark, folder, models)
    assert sets.count() * 2 == mm.each_model(sets).count() < direct.count()
    assert got.columns == direct.columns
    assert got.exceptAll(direct).isEmpty() and direct.exceptAll(got).isEmpty()


def test_tagged_metrics_are_those_of_the_lead_table(spark):
    """One pass with the verdicts gathered beside the means; a crossing voids its cell only."""
    rows = [
        (model, t, 0, 2, 2, s, g, step, "x", p, y, [0.1, 0.5, 0.9], [p - 1.0, p, p + up])
        for model, up in (("ordered", 1.0), ("crossing", 1.0))
        for t, s, g, p, y in (("a1", "a", "g1", 1.0, 1.5), ("a2", "a", "g1", 2.0, 5.0), ("b1", "b", "g2", 4.0, 3.0))
        for step in (1, 2)
    ]
    rows[-1] = (*rows[-1][:-1], [5.0, 4.0, 3.0])
    predictions = spark.createDataFrame(
        rows,
        "model string, trajectory_id string, start int, context_frames int, horizon_frames int, "
        "system_id string, group_id string, step int, feature_id string, point double, target double, "
        "levels array<double>, quantiles array<double>",
    )
    levels, intervals = (0.1, 0.5, 0.9), ((0.1, 0.9),)
    want = dg.system_metrics(dg.lead_table(dg.tag_crossings(predictions), levels, intervals))
    got = dg.tagged_system_metrics(predictions, levels, intervals)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = ({(r["model"], r["group_id"]): r.asDict() for r in t.collect()} for t in (got, want))
    assert got == want and len(got) == 4
    assert got["crossing", "g1"]["width-0.1-0.9"] is None and got["crossing", "g1"]["mae"] > 0
    assert got["ordered", "g1"]["coverage-0.1-0.9"] == 0.5


def window_points(spark, *points):
    """Rows of one model's points on targets of 1.0 and 2.0, a trajectory each."""
    held = [(f"t{i}", 0, 3, 2, f"s{i // 2}", "g", "x", "m", p, [1.0, 2.0]) for i, p in enumerate(points)]
    return spark.createDataFrame(
        held,
        "trajectory_id string, start int, context_frames int, horizon_frames int, system_id string, "
        "group_id string, feature_id string, model string, points array<double>, target array<double>",
    ).withColumns({"origin": F.lit(0.0), "split": F.lit("train")})


def test_group_steps_are_those_of_the_rows(spark):
    """A column per lead gives what a row per lead gives, whatever the declared leads."""
    points = window_points(spark, [1.0, 4.0], [3.0, 2.5], [0.5, 9.0])
    scaler = spark.createDataFrame([("x", 2.0)], "feature_id string, scale double")
    want = ls.group_metric(ls.losses(fc.predictions(points), scaler))
    for leads in (2, 5):
        got = ls.group_steps(points, ls.lead_error, leads, scaler)
        assert got.columns == want.columns
        assert {(r["step"], r["value"]) for r in got.collect()} == {(r["step"], r["value"]) for r in want.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate") == 1
    for unfit, leads, scale, message in (
        ([float("nan"), 1.0], 2, scaler, "point is not finite"),
        ([1.0, 1.0], 1, scaler, "longer than the declared leads"),
        ([1.0, 1.0], 2, scaler.filter("scale < 0"), "no scale"),
        ([1.0, 1.0], 2, scaler.withColumn("scale", F.lit(0.0)), "not finite and positive"),
    ):
        with pytest.raises(Exception, match=message):
            ls.group_steps(window_points(spark, unfit), ls.lead_error, leads, scale).collect()


def test_coverage_of_windows_is_that_of_their_rows(spark):
    points = window_points(spark, [1.0, 4.0], [3.0, 2.5], [0.5, 9.0])
    levels, interval = [0.1, 0.5, 0.9], (0.1, 0.9)
    rows = fc.predictions(points)
    offsets = rs.fit_residual_quantiles(rows, levels)
    scaler = spark.createDataFrame([("x", 2.0)], "feature_id string, scale double")
    losses = ls.losses(rs.apply_residuals(rows, offsets), scaler, levels, [interval])
    want = ls.hierarchy(losses).filter("level = 'aggregate' AND metric = 'coverage'")
    inside = ls.with_interval(points, offsets, levels, interval, 2)
    got = ls.aggregate_rows(ls.group_steps(inside, ls.lead_coverage, 2), "coverage", *interval)
    assert {c for c, _ in got.dtypes} == {c for c, _ in want.dtypes}
    assert {(r["step"], r["value"], r["upper_q"]) for r in got.collect()} == {
        (r["step"], r["value"], r["upper_q"]) for r in want.collect()
    }
    lost = ls.with_interval(points, offsets.filter("step = 1"), levels, interval, 2)
    with pytest.raises(Exception, match="no residual offsets"):
        ls.group_steps(lost, ls.lead_coverage, 2).collect()


def largest_method(df):
    """Bytes of the largest generated method; HotSpot compiles none above 8,000."""
    package = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package")
    text = package.codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_lead_columns_stay_in_methods_that_are_compiled(spark):
    points = window_points(spark, [1.0, 4.0]).withColumn("forecasts", F.array(F.struct("model", "points")))
    sets = points.drop("model", "points").select("*", F.inline_outer("forecasts"))
    scaler = spark.createDataFrame([("x", 2.0)], "feature_id string, scale double")
    series = "model string, context_frames int, horizon_frames int, feature_id string, step int, offsets array<double>"
    offsets = spark.createDataFrame([("m", 3, 2, "x", step, [-1.0, 0.0, 1.0]) for step in (1, 2)], series)
    inside = ls.with_interval(sets, offsets, [0.1, 0.5, 0.9], (0.1, 0.9), 10)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows, element in ((sets, ls.lead_error), (inside, ls.lead_coverage)):
            assert 0 < largest_method(ls.group_steps(rows, element, 10, scaler)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize(
    "unfit, message",
    [
        ([None, 1.0], "point is not finite"),
        ([1.0], "point is not finite"),
        ([1.0, float("inf")], "point is not finite"),
        ([1.0, -float("inf")], "point is not finite"),
    ],
)
def test_unfit_points_stop_the_lead_columns(spark, unfit, message):
    with pytest.raises(Exception, match=message):
        ls.group_steps(window_points(spark, unfit), ls.lead_error, 2).collect()


def test_unfit_targets_stop_the_lead_columns(spark):
    points = window_points(spark, [1.0, 4.0])
    unknown = points.withColumn("target", F.array(F.lit(None).cast("double"), F.lit(3.0)))
    got = {r["step"]: r["value"] for r in ls.group_steps(unknown, ls.lead_error, 2).collect()}
    assert got == {0: 1.0, 1: None, 2: 1.0}
    with pytest.raises(Exception, match="a loss is not a finite number"):
        ls.group_steps(points.withColumn("target", F.array(F.lit(1.0), F.lit(float("nan")))), ls.lead_error, 2).collect()


def test_levels_of_windows_are_those_of_the_rows(spark):
    """Means with columns per lead give what a row per lead gives, and no row per lead is made for them."""
    points = window_points(spark, [1.0, 4.0], [3.0, 2.5], [0.5, 9.0])
    points = points.unionByName(points.withColumns({"start": F.lit(5), "target": F.array(F.lit(0.5), F.lit(None).cast("double"))}))
    scaler = spark.createDataFrame([("x", 2.0)], "feature_id string, scale double")
    want = ls.level_means(ls.losses(fc.predictions(points), scaler))
    policy = inf.Policy(seed=1, samples=20, min_groups=1, min_tail=0)
    for leads in (2, 5):
        got = ls.level_means_of_windows(points, scaler, leads)
        assert list(got) == list(want)
        for level, df in got.items():
            assert sorted(df.columns) == sorted(want[level].columns)
            values = [
                {tuple(r[c] for c in ("step", *([f"{level}_id"] if level != "aggregate" else []))):
                 (r["mae"], r["rmse"], r["scaled-mae"]) for r in rows.collect()} for rows in (df, want[level])
            ]
            assert values[0].keys() == values[1].keys()
            for key, row in values[0].items():
                assert row == pytest.approx(values[1][key], nan_ok=True)
        whole = ls.hierarchy_of(got, policy)
        assert whole.filter("ci_lower IS NOT NULL").select("level").distinct().collect() == [("aggregate",)]
        assert whole.filter("level = 'aggregate' AND ci_lower IS NULL").count() == 0
    for unfit, leads, scale, message in (
        ([float("nan"), 1.0], 2, scaler, "point is not finite"),
        ([1e200, 1.0], 2, scaler, "a loss is not a finite number"),
        ([1.0, 1.0], 1, scaler, "longer than the declared leads"),
        ([1.0, 1.0], 2, scaler.filter("scale < 0"), "no scale"),
        ([1.0, 1.0], 2, scaler.withColumn("scale", F.lit(0.0)), "not finite and positive"),
    ):
        with pytest.raises(Exception, match=message):
            ls.level_means_of_windows(window_points(spark, unfit), scale, leads)["aggregate"].collect()


def test_lead_columns_of_levels_stay_in_methods_that_are_compiled(spark, monkeypatch):
    points = window_points(spark, [1.0, 4.0]).withColumn("forecasts", F.array(F.struct("model", "points")))
    sets = points.drop("model", "points").select("*", F.inline_outer("forecasts"))
    scaler = spark.createDataFrame([("x", 2.0)], "feature_id string, scale double")
    plans = []
    monkeypatch.setattr(ls, "cut", lambda df: plans.append(df) or df)
    ls.level_means_of_windows(sets, scaler, 10)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "posexplode" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < largest_method(spark.createDataFrame([], plans[0].schema).unionByName(plans[0])) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
