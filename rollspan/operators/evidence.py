"""Tables behind the published curves, panels and headline numbers."""

from pyspark.sql import functions as F

from rollspan.functions.checked import bounded, required
from rollspan.functions.hashing import fingerprint_frame
from rollspan.functions.quantiles import exact_quantiles
from rollspan.tables import CELL, WINDOW_KEY


def evidence(metrics, features):
    """Whole-horizon aggregate rows with selector, unit and table fingerprint."""
    rows = metrics.filter((F.col("level") == "aggregate") & (F.col("step") == 0))
    unit = F.when(F.col("metric").isin("coverage", "scaled-mae"), "dimensionless").otherwise(
        required(F.col("unit"), "a feature has no unit")
    )
    selector = F.concat_ws(
        "|", "level", "model", "feature_id", F.col("step").cast("string"), "metric",
        F.col("lower_q").cast("string"), F.col("upper_q").cast("string"),
    )
    stored = metrics.withColumn("value", F.round("value", 9))
    mark = fingerprint_frame(stored).select("fingerprint").scalar()
    return rows.join(bounded(features.select("feature_id", "unit")), "feature_id", "left").select(
        *CELL, selector.alias("selector"), "value", unit.alias("unit"), mark.alias("table_hash")
    )


def horizon_curves(metrics, trajectories):
    """Aggregate MAE by step; picoseconds only for one verified interval."""
    one = (
        F.bool_and(F.col("sampling_status") == "verified")
        & (F.min("frame_interval_ps") == F.max("frame_interval_ps"))
        & (F.count_if(F.col("frame_interval_ps").isNull()) == 0)
    )
    interval = trajectories.agg(F.when(one, F.min("frame_interval_ps"))).scalar()
    physical = F.col("_interval").isNotNull()
    rows = metrics.filter(
        (F.col("level") == "aggregate") & (F.col("metric") == "mae") & (F.col("step") > 0)
    )
    return rows.withColumn("_interval", interval).select(
        "model", *CELL, "feature_id", "step",
        F.when(physical, F.col("step") * F.col("_interval"))
        .otherwise(F.col("step").cast("double"))
        .alias("x"),
        F.when(physical, "ps").otherwise("frame").alias("x_unit"),
        "value",
    )


def calibration_curves(metrics):
    """Nominal against empirical coverage over the whole horizon."""
    rows = metrics.filter(
        (F.col("level") == "aggregate") & (F.col("metric") == "coverage") & (F.col("step") == 0)
    )
    return rows.select(
        "model", *CELL, "feature_id",
        (F.col("upper_q") - F.col("lower_q")).alias("nominal"),
        F.col("value").alias("coverage"),
    )


def runtime_summary(runtime):
    """Total seconds and peak bytes per model; unmeasured stays null."""
    return runtime.groupBy("model").agg(
        F.sum("seconds").alias("seconds"),
        F.max("peak_allocated_bytes").alias("peak_allocated_bytes"),
        F.max("peak_reserved_bytes").alias("peak_reserved_bytes"),
    )


def qc_summary(qc):
    """Per feature, median lag-1 autocorrelation, median decay and censored count."""
    long = qc.select(
        "feature_id",
        F.inline(
            F.array(
                F.struct(F.lit("rho").alias("_k"), F.element_at("acf", 2).alias("_v")),
                F.struct(
                    F.lit("decay").alias("_k"), F.col("decay_frames").cast("double").alias("_v")
                ),
            )
        ),
    )
    medians = exact_quantiles(
        long.filter(F.col("_v").isNotNull()), ["feature_id", "_k"], "_v", (0.5,), "_q"
    )
    wide = medians.groupBy("feature_id").agg(
        F.max(F.when(F.col("_k") == "rho", F.element_at("_q", 1))).alias("median_acf_lag1"),
        F.max(F.when(F.col("_k") == "decay", F.element_at("_q", 1))).alias("median_decay"),
    )
    counts = qc.groupBy("feature_id").agg(F.count_if("decay_censored").alias("censored"))
    return counts.join(wide, "feature_id", "left")


def panels(predictions):
    """Per window and feature, target, each model's points and its (0.1, 0.9) band.

    A model with any invalid lead has no band; its failed quantiles are kept by lead.
    """
    low, high = F.array_position("levels", 0.1), F.array_position("levels", 0.9)
    has = F.col("quantiles_valid") & (low > 0) & (high > 0)
    band = F.when(
        F.coalesce(has, F.lit(False)),
        F.array(
            F.get("quantiles", (low - 1).cast("int")), F.get("quantiles", (high - 1).cast("int"))
        ),
    )
    failed = F.when(~F.col("quantiles_valid"), F.col("quantiles"))
    steps = F.sort_array(
        F.collect_list(
            F.struct(
                "step", "target", "point", band.alias("band"), failed.alias("failed")
            )
        )
    )
    window = [*WINDOW_KEY, "group_id", "feature_id", "origin"]
    per_model = predictions.groupBy(*window, "model").agg(steps.alias("_s"))
    entry = F.struct(
        F.col("model").alias("key"),
        F.struct(
            F.transform("_s", lambda s: s["point"]).alias("points"),
            F.when(
                F.forall("_s", lambda s: s["band"].isNotNull()),
                F.transform("_s", lambda s: s["band"]),
            ).alias("bands"),
            F.map_from_entries(
                F.transform(
                    F.filter("_s", lambda s: s["failed"].isNotNull()),
                    lambda s: F.struct(s["step"], s["failed"]),
                )
            ).alias("failed"),
        ).alias("value"),
    )
    return per_model.groupBy(*window).agg(
        F.transform(F.min_by("_s", "model"), lambda s: s["target"]).alias("target"),
        F.map_from_entries(F.collect_list(entry)).alias("models"),
    )


def metric_view(errors, probability):
    """One long (model, lead, metric, value, bounds, status) table."""
    keys = ["model", *CELL, "feature_id", "lead"]
    point = errors.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                    for m in ("mae", "rmse", "bias")
                ]
            )
        ),
        F.lit(None).cast("double").alias("ci_lower"),
        F.lit(None).cast("double").alias("ci_upper"),
        F.lit(None).cast("string").alias("status"),
    )
    interval = probability.select(
        *keys, "metric", F.col("mean").alias("value"),
        F.col("marginal_lower").alias("ci_lower"),
        F.col("marginal_upper").alias("ci_upper"),
        F.col("marginal_status").alias("status"),
    )
    return point.unionByName(interval)
