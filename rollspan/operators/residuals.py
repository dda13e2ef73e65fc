"""Residual-quantile intervals around statistical points."""

from pyspark.sql import functions as F

from rollspan.functions.checked import bounded, required
from rollspan.functions.quantiles import exact_quantiles

LEAD = ("model", "context_frames", "horizon_frames", "step", "feature_id")


def fit_residual_quantiles(train_predictions, levels):
    """per lead and channel, quantiles of pooled TRAIN residuals.

    Offsets below the median are at most zero, above it at least zero, and the
    median offset is zero, so the point forecast stays the median.
    """
    if 0.5 not in levels or sorted(set(levels)) != list(levels):
        raise ValueError("levels must be ordered, unique and hold 0.5")
    rows = train_predictions.select(*LEAD, (F.col("target") - F.col("point")).alias("residual"))
    raw = exact_quantiles(rows, LEAD, "residual", levels, "_raw")
    offsets = []
    for i, q in enumerate(levels, start=1):
        value = F.element_at("_raw", i)
        if q < 0.5:
            value = F.least(value, F.lit(0.0))
        elif q > 0.5:
            value = F.greatest(value, F.lit(0.0))
        else:
            value = F.lit(0.0)
        offsets.append(value)
    return raw.select(
        *LEAD,
        F.array(*[F.lit(float(q)) for q in levels]).alias("levels"),
        F.array(*offsets).alias("offsets"),
    )


def apply_residuals(predictions, offsets):
    """point plus the offsets of its lead and channel.

    The offset table has one row per model, cell, lead and channel. The declared
    grid bounds it, so it is broadcast: predictions are not shuffled by so few keys.
    A prediction without offsets stops the job.
    """
    return (
        predictions.drop("levels", "quantiles")
        .join(bounded(offsets.select(*LEAD, "levels", "offsets")), list(LEAD), "left")
        .withColumn("offsets", required(F.col("offsets"), "a prediction has no residual offsets"))
        .withColumn("quantiles", F.transform("offsets", lambda o: F.col("point") + o))
        .drop("offsets")
    )
