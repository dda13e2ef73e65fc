"""Scalers fitted on observed TRAIN contexts only."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions import blocks as blk
from rollspan.functions.arrays import deviations, mean, total
from rollspan.functions.blocks import block_of
from rollspan.functions.checked import bounded, required


def in_regions(frames, regions):
    """Frames inside [start, stop) regions, each once.

    Regions are cut at the block bounds and laid between the frames of their block; one
    ordered pass carries the furthest stop so far, and a frame before it is inside. So a
    region costs one row a block, however many frames it covers.
    """
    block = F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("stop") - 1)))
    cut_up = regions.filter(F.col("start") < F.col("stop")).select(
        "trajectory_id", "start", "stop", block.alias("_block")
    )
    low = F.greatest(F.col("start"), F.col("_block") * blk.BLOCK).cast("long")
    laid = cut_up.select(
        "trajectory_id", "_block", low.alias("frame"), F.col("stop").cast("long").alias("_stop")
    )
    rows = frames.withColumn("_block", block_of(F.col("frame"))).unionByName(laid, allowMissingColumns=True)
    order = Window.partitionBy("trajectory_id", "_block").orderBy("frame", F.desc_nulls_last("_stop"))
    reach = F.max("_stop").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_reach", reach)
        .filter(F.col("_stop").isNull() & (F.col("frame") < F.col("_reach")))
        .select(*frames.columns)
    )


def fit_scaler(frames, regions, features):
    """Mean and population deviation of each region frame, counted once.

    One mergeable aggregate over all features; a zero deviation becomes scale 1.
    """
    aggregates = []
    for name in features:
        aggregates += [
            F.avg(name).alias(f"_m_{name}"),
            F.stddev_pop(name).alias(f"_s_{name}"),
            F.count(name).alias(f"_n_{name}"),
        ]
    row = in_regions(frames.select("trajectory_id", "frame", *features), regions).agg(*aggregates)
    fitted = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature_id"),
                F.col(f"_m_{name}").alias("center"),
                F.when(F.col(f"_s_{name}") == 0, 1.0)
                .otherwise(F.col(f"_s_{name}"))
                .alias("scale"),
                F.col(f"_n_{name}").alias("sample_count"),
            )
            for name in features
        ]
    )
    scaler = row.select(F.inline(fitted))
    finite = F.abs("center") + F.abs("scale") < F.lit(float("inf"))
    return scaler.withColumn(
        "scale",
        F.when(finite | (F.col("sample_count") == 0), F.col("scale")).otherwise(
            F.raise_error(F.lit("scaler moments are not finite"))
        ),
    )


def fit_context_scaler(arrays):
    """The same moments from each window's own context."""
    keep = [c for c in arrays.columns if c not in ("context", "target")]
    spread = F.sqrt(
        total(F.transform(deviations(F.col("context")), lambda d: d * d)) / F.size("context")
    )
    return arrays.select(*keep, mean(F.col("context")).alias("center"), spread.alias("scale")).withColumn(
        "scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    )


def scale(df, scaler, columns=("value",), inverse=False, keys=("feature_id",)):
    """(x - center) / scale or back, for double and array columns alike.

    A scaler keyed by feature alone holds one row per declared feature and is
    broadcast; any other key is left to Spark's size check. A row without a fitted
    scaler stops the job.
    """
    fitted = scaler.select(*keys, "center", "scale")
    if tuple(keys) == ("feature_id",):
        fitted = bounded(fitted)
    joined = df.join(fitted, list(keys), "left")
    for name in ("center", "scale"):
        joined = joined.withColumn(name, required(F.col(name), f"a row has no fitted {name}"))
    types = dict(df.dtypes)

    def apply(x):
        c, s = F.col("center"), F.col("scale")
        return x * s + c if inverse else (x - c) / s

    for name in columns:
        value = F.col(name)
        changed = F.transform(value, apply) if types[name].startswith("array") else apply(value)
        joined = joined.withColumn(name, changed)
    return joined.drop("center", "scale")
