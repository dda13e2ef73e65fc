import numpy as np
import pandas as pd
import pytest

from rollspan.operators import coupling as cp
from rollspan.operators import forecasts as fc
from rollspan.operators import nlinear as nl
from tests.least_squares import continued, lag_columns, slope_and_level


def test_vector_autoregression_against_least_squares(spark):
    values = np.random.default_rng(7).normal(size=(14, 2))
    rows = [("t", 0, 14, 3, [("a", values[:, 0].tolist(), [0.0] * 3),
                             ("b", values[:, 1].tolist(), [0.0] * 3)])]
    channels = spark.createDataFrame(
        rows,
        "trajectory_id string, start long, context_frames int, horizon_frames int, "
        "channels array<struct<feature_id: string, context: array<double>, target: array<double>>>",
    )
    out = fc.forecast_channels(channels, {"var2": fc.vector_autoregression(2, 0.5)}).collect()
    want = continued(pd.DataFrame(values), 2, 0.5, 3)
    got = {r["feature_id"]: r["points"] for r in out}
    assert got["a"] == pytest.approx(list(want[:, 0])) and got["b"] == pytest.approx(list(want[:, 1]))


@pytest.mark.parametrize("lags,ridge", [(1, 1.0), (1, 0.0), (2, 1.0), (3, 0.2)])
def test_lag_gain_against_least_squares(spark, lags, ridge):
    a, b = np.random.default_rng(8).normal(size=(2, 20))
    df = spark.createDataFrame(
        [("t", 0, 20, 1, "s", "g", a.tolist(), b.tolist())],
        "trajectory_id string, start long, context_frames int, horizon_frames int, "
        "system_id string, group_id string, a array<double>, b array<double>",
    )
    z = np.stack([(v - v.mean()) / v.std() for v in (b, a)], axis=1)

    def left_over(columns):
        x, _ = lag_columns(pd.DataFrame(columns), lags)
        slope, level = slope_and_level(x, z[lags:, :1], ridge)
        return float(np.square(z[lags:, :1] - x @ slope - level).sum())

    want = 1 - left_over(z) / left_over(z[:, :1])
    assert cp.lag_gain(df, lags, ridge).first()["gain"] == pytest.approx(want)


def test_selection_takes_the_first_of_equals(spark):
    scores = spark.createDataFrame(
        [("n-2", 0.5), ("n-1", 0.5), ("n-0", 0.7), ("other", 0.1)], "model string, score double"
    )
    row = nl.select_nlinear(scores, ["n-0", "n-1", "n-2"]).first()
    assert (row["model"], row["score"]) == ("n-1", 0.5)


def test_selection_without_all_scores_is_refused(spark):
    none = spark.createDataFrame([], "model string, score double")
    for scores in (none, spark.createDataFrame([("n-0", 1.0), ("n-1", None)], none.schema)):
        with pytest.raises(Exception, match="no validation score"):
            nl.select_nlinear(scores, ["n-0", "n-1"]).collect()
