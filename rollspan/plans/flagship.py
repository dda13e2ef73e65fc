"""The smallest complete plan: series to windows to forecasts to a paired answer."""

from pyspark.sql import functions as F

from rollspan.operators.forecasts import predictions
from rollspan.operators.losses import group_metric, losses
from rollspan.operators.moments import context_mean, forecast, persistence
from rollspan.plans import testbed as tb
from rollspan.plans.registry import rounded
from rollspan.plans.sql import CELL, EVENTS, pred, r


def mean_against_persistence(spark, sf_dir):
    """Group MAE of the context mean less persistence, per lead and feature."""
    models = {"persistence": persistence, "context-mean": context_mean}
    rows = predictions(forecast(tb.event_moments(spark, sf_dir), models))
    unit = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature_id"), F.lit(1.0).alias("scale"))
                    for f in tb.EVENT_FEATURES
                ]
            )
        )
    )
    groups = group_metric(losses(rows, unit))
    wide = groups.groupBy("context_frames", "horizon_frames", "feature_id", "step", "group_id").pivot(
        "model", list(models)
    ).agg(F.first("value"))
    means = wide.groupBy("context_frames", "horizon_frames", "feature_id", "step").agg(
        F.avg(F.col("context-mean") - F.col("persistence")).alias("mae_difference"),
        (F.avg("context-mean") / F.nullif(F.avg("persistence"), F.lit(0.0))).alias("ratio"),
        F.count(F.lit(1)).alias("groups"),
    )
    return rounded(means)


MEAN_AGAINST_PERSISTENCE = f"""{pred(EVENTS, ["persistence", "context-mean"])},
t AS (
  SELECT model, {CELL}, feature_id, step, trajectory_id, system_id, group_id,
    avg(abs(point - target)) AS v FROM pred GROUP BY ALL
  UNION ALL SELECT model, {CELL}, feature_id, 0, trajectory_id, system_id, group_id,
    avg(abs(point - target)) FROM pred GROUP BY ALL),
s AS (SELECT model, {CELL}, feature_id, step, system_id, group_id, avg(v) AS v FROM t GROUP BY ALL),
g AS (SELECT model, {CELL}, feature_id, step, group_id, avg(v) AS v FROM s GROUP BY ALL)
SELECT {CELL}, feature_id, step::INTEGER AS step, {r("avg(a.v - b.v)")} AS mae_difference,
  {r("avg(a.v) / nullif(avg(b.v), 0)")} AS ratio, count(*) AS groups
FROM g a JOIN g b USING ({CELL}, feature_id, step, group_id)
WHERE a.model = 'context-mean' AND b.model = 'persistence'
GROUP BY ALL"""
