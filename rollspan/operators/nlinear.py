"""Direct linear forecaster on last-value-centred contexts.

The fit is a tall least-squares problem: a task reduces its windows to one small
triangular factor per channel, and factors are merged in a two-level tree (TSQR): a
merge sees one factor per FAN_IN tasks, then FAN_IN of them. The condition number is
never squared.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rollspan.functions.arrays import dot, let
from rollspan.functions.checked import bounded, required
from rollspan.operators.scaling import scale

FAN_IN = 256
FACTOR = "feature_id string, node long, rows long, columns int, factor array<double>"


def _reduce(stack):
    """R factor of a stack of rows, padded to a square."""
    factor = np.linalg.qr(stack, mode="r") if len(stack) else np.zeros((0, stack.shape[1]))
    padded = np.zeros((stack.shape[1], stack.shape[1]))
    padded[: len(factor)] = factor
    return padded


def _task_factors(context_frames, horizon_frames):
    """Fold Arrow batches into one running factor per channel."""
    width = context_frames + 1 + horizon_frames

    def fold(batches):
        held, counts, node = {}, {}, None
        for batch in batches:
            if not len(batch):
                continue
            node = int(batch["node"].iloc[0])
            for feature, rows in batch.groupby("feature_id"):
                context = np.stack(rows["context"].to_numpy())
                target = np.stack(rows["target"].to_numpy())
                last = context[:, -1:]
                block = np.hstack([context - last, np.ones((len(rows), 1)), target - last])
                if not np.isfinite(block).all():
                    raise ValueError("training values are not finite")
                above = held.get(feature, np.zeros((0, width)))
                held[feature] = _reduce(np.vstack([above, block]))
                counts[feature] = counts.get(feature, 0) + len(rows)
        for feature, factor in held.items():
            yield pd.DataFrame(
                {
                    "feature_id": [feature],
                    "node": [node],
                    "rows": [counts[feature]],
                    "columns": [width],
                    "factor": [factor.ravel()],
                }
            )

    return fold


def _merge(rows):
    width = int(rows["columns"].iloc[0])
    stack = np.vstack([np.asarray(f).reshape(width, width) for f in rows["factor"]])
    return pd.DataFrame(
        {
            "feature_id": [rows["feature_id"].iloc[0]],
            "node": [rows["parent"].iloc[0]],
            "rows": [rows["rows"].sum()],
            "columns": [width],
            "factor": [_reduce(stack).ravel()],
        }
    )


def design_factors(arrays, scaler, context_frames, horizon_frames):
    """one triangular factor of [design, labels] per channel, TRAIN rows in."""
    wanted = (F.col("context_frames") == context_frames) & (
        F.col("horizon_frames") == horizon_frames
    )
    rows = scale(
        arrays.filter(wanted).select("feature_id", "context", "target"),
        scaler,
        ("context", "target"),
    ).withColumn("node", F.spark_partition_id().cast("long"))
    level = rows.mapInPandas(_task_factors(context_frames, horizon_frames), FACTOR)
    for parent in (F.col("node") % FAN_IN, F.lit(0).cast("long")):
        level = (
            level.withColumn("parent", parent)
            .groupBy("feature_id", "parent")
            .applyInPandas(_merge, FACTOR)
        )
    return level.select("feature_id", "rows", "columns", "factor")


def _collect(factors):
    """The root factors: (C+1+H)^2 numbers per declared channel."""
    out = {}
    for row in factors.collect():
        width = row["columns"]
        out[row["feature_id"]] = (row["rows"], np.array(row["factor"]).reshape(width, width))
    return out


def _penalty(ridge, columns):
    return np.diag(np.append(np.full(columns - 1, np.sqrt(ridge)), 0.0))


def solve(factors, context_frames, ridges):
    """weights for every ridge from the same factors.

    The intercept is free, and a rank-deficient design (its last centred column is
    zero) takes the minimum-norm solution.
    """
    p = context_frames + 1
    records = []
    for feature, (_, factor) in sorted(_collect(factors).items()):
        for ridge in ridges:
            design, labels = factor[:, :p], factor[:, p:]
            if ridge > 0:
                design = np.vstack([design, _penalty(ridge, p)])
                labels = np.vstack([labels, np.zeros((p, labels.shape[1]))])
            weights = np.linalg.lstsq(design, labels, rcond=None)[0]
            if not np.isfinite(weights).all():
                raise ValueError("fitted weights are not finite")
            records += [
                (float(ridge), feature, h + 1, [float(x) for x in weights[:, h]])
                for h in range(weights.shape[1])
            ]
    spark = factors.sparkSession
    return spark.createDataFrame(
        records, "ridge double, feature_id string, step int, weights array<double>"
    )


def fit_nlinear(arrays, scaler, context_frames, horizon_frames, ridges):
    """fit every ridge on all TRAIN windows of one cell in one pass."""
    train = arrays.filter(F.col("split") == "train") if "split" in arrays.columns else arrays
    factors = design_factors(train, scaler, context_frames, horizon_frames)
    return solve(factors, context_frames, ridges)


def predict_nlinear(arrays, scaler, weights, name=None):
    """design times weights plus the last value, back in native units.

    Weight rows number channels x leads x ridges, all declared, so they and the
    scaler are broadcast. A window of another cell, or a channel without weights or
    scaler, stops the job.
    """
    label = F.lit(name) if name else F.concat(F.lit("nlinear-"), F.col("ridge").cast("string"))
    packed = weights.groupBy("ridge", "feature_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("step", "weights"))), lambda s: s["weights"]
        ).alias("_w"),
        F.max("step").alias("_h"),
        F.max(F.size("weights")).alias("_p"),
    )
    fits = (F.col("horizon_frames") == F.col("_h")) & (F.col("context_frames") + 1 == F.col("_p"))
    stop = F.raise_error(F.lit("the weights are for another cell"))
    joined = (
        arrays.join(bounded(packed), "feature_id", "left")
        .withColumn("_w", F.when(F.coalesce(fits, F.lit(False)), F.col("_w")).otherwise(stop))
        .join(bounded(scaler.select("feature_id", "center", "scale")), "feature_id", "left")
        .withColumn("scale", required(F.col("scale"), "a channel has no scaler"))
    )
    last = F.element_at("context", -1)
    design = F.concat(
        F.transform("context", lambda x: (x - last) / F.col("scale")), F.array(F.lit(1.0))
    )
    points = let(
        design,
        lambda d: F.transform("_w", lambda w: dot(d, w) * F.col("scale") + last),
    )
    keep = [c for c in arrays.columns if c != "context"]
    return joined.select(*keep, last.alias("origin"), label.alias("model"), points.alias("points"))


def select_nlinear(scores, candidates):
    """F8: candidate with the lowest validation score; the first wins ties."""
    order = F.create_map(*[F.lit(x) for i, name in enumerate(candidates) for x in (name, i)])
    ranked = scores.withColumn("ordinal", order[F.col("model")]).filter(
        F.col("ordinal").isNotNull()
    )
    whole = (F.count_distinct(F.when(F.col("score").isNotNull(), F.col("ordinal")))) == len(candidates)
    stop = F.raise_error(F.lit("a candidate has no validation score"))
    return ranked.agg(
        F.when(whole, F.min_by("model", F.struct("score", "ordinal"))).otherwise(stop).alias("model"),
        F.min("score").alias("score"),
    )


def conditioning(factors, context_frames, horizon_frames, ridges):
    """rank, condition number and parameters of each (augmented) design."""
    p = context_frames + 1
    records = []
    for feature, (rows, factor) in sorted(_collect(factors).items()):
        for ridge in ridges:
            design = factor[:, :p]
            height = rows
            if ridge is not None:
                design = np.vstack([design, _penalty(ridge, p)])
                height += p
            values = np.linalg.svd(design, compute_uv=False)
            tolerance = values[0] * max(height, p) * np.finfo(float).eps
            rank = int((values > tolerance).sum())
            number = float(values[0] / values[-1]) if rank == p else None
            records.append(
                (feature, ridge, int(rows), p, rank, number, p * horizon_frames)
            )
    return factors.sparkSession.createDataFrame(
        records,
        "feature_id string, ridge double, rows long, columns int, rank int, "
        "condition_number double, parameters int",
    )
