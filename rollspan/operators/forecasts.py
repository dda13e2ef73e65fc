"""Context-only forecasts.

A model is a function from (context, horizon) columns to an array of H points, so a
set of models runs in one pass over the window rows.
"""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rollspan.functions.arrays import dot, let, mean, total
from rollspan.tables import WINDOW_KEY


def persistence(context, horizon):
    """the last observed value, H times."""
    return F.array_repeat(F.element_at(context, -1), horizon)


def context_mean(context, horizon):
    """the context mean, H times."""
    return let(mean(context), lambda m: F.array_repeat(m, horizon))


def linear(context, horizon):
    """least-squares line over 0..C-1, evaluated at C..C+H-1."""
    n = F.size(context)
    middle = (n - 1) / F.lit(2.0)
    moments = F.struct(
        mean(context).alias("m"),
        total(F.transform(context, lambda x, i: x * (i - middle))).alias("sxt"),
        (n * (n * n - 1) / F.lit(12.0)).alias("stt"),
        middle.alias("mid"),
        n.alias("n"),
        horizon.cast("int").alias("h"),
    )
    line = let(
        moments,
        lambda s: F.transform(
            F.sequence(F.lit(0), s["h"] - 1),
            lambda k: s["m"] + s["sxt"] / s["stt"] * (s["n"] + k - s["mid"]),
        ),
    )
    return F.when(n >= 2, line).otherwise(
        F.raise_error(F.lit("a linear forecast needs two observed frames"))
    )


def ar1_path(known, ridge):
    """Recursive points of the ridge line through (x[t-1], x[t]).

    `known` has the sums s (x, y, xx, xy) about f over n pairs, the last value, the
    horizon h and whether all lagged values are equal (flat). With no spread in the
    lagged values and no penalty the minimum-norm solution shares the level between
    slope and intercept.
    """

    def line(k):
        s, m = k["s"], k["n"]
        sxx = s["xx"] - s["x"] * s["x"] / m
        sxy = s["xy"] - s["x"] * s["y"] / m
        mx, my = k["f"] + s["x"] / m, k["f"] + s["y"] / m
        flat = k["flat"] & F.lit(ridge == 0)
        level = my / (mx * mx + 1)
        slope = F.when(k["flat"], mx * level if ridge == 0 else F.lit(0.0)).otherwise(
            F.coalesce(sxy / F.nullif(sxx + F.lit(float(ridge)), F.lit(0.0)), F.lit(0.0))
        )
        return F.struct(
            slope.alias("b"), mx.alias("mx"), my.alias("my"), level.alias("level"),
            flat.alias("flat"), k["last"].alias("last"), k["h"].alias("h"),
        )

    def recurse(c):
        def step(path, _):
            before = F.element_at(path, -1)
            fitted = c["my"] + c["b"] * (before - c["mx"])
            return F.concat(
                path,
                F.array(F.when(c["flat"], c["level"] + c["b"] * before).otherwise(fitted)),
            )

        path = F.aggregate(F.sequence(F.lit(1), c["h"]), F.array(c["last"]), step)
        return F.slice(path, F.lit(2), c["h"])

    return let(let(known, line), recurse)


def autoregression1(ridge=0.0):
    """F4 with p = 1: closed form over the values of a context."""

    def model(context, horizon):
        n = F.size(context)
        first = F.element_at(context, 1)

        def sums(v):
            x, y = F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1)
            return F.struct(
                total(x).alias("x"),
                total(y).alias("y"),
                F.aggregate(x, F.lit(0.0), lambda acc, a: acc + a * a).alias("xx"),
                dot(x, y).alias("xy"),
            )

        known = F.struct(
            let(F.transform(context, lambda x: x - first), sums).alias("s"),
            (n - 1).cast("double").alias("n"),
            first.alias("f"),
            F.element_at(context, -1).alias("last"),
            horizon.cast("int").alias("h"),
            F.forall(F.slice(context, F.lit(1), n - 1), lambda x: x == first).alias("flat"),
        )
        return F.when(n >= 3, ar1_path(known, ridge)).otherwise(
            F.raise_error(F.lit("too few observed frames for one lag"))
        )

    return model


def lagged_ridge(values, horizon, lags, ridge):
    """Recursive least-squares forecasts of a batch of (windows, frames, channels)."""
    windows, frames, channels = values.shape
    width = lags * channels + 1
    if frames - lags < width:
        raise ValueError(f"{frames - lags} frames after the lags cannot fit {width} weights")
    stacked = [values[:, lag : frames - lags + lag, :] for lag in range(lags)]
    design = np.concatenate(stacked + [np.ones((windows, frames - lags, 1))], axis=2)
    labels = values[:, lags:, :]
    if ridge > 0:
        penalty = np.diag(np.append(np.full(width - 1, np.sqrt(ridge)), 0.0))
        design = np.concatenate([design, np.broadcast_to(penalty, (windows, width, width))], axis=1)
        labels = np.concatenate([labels, np.zeros((windows, width, channels))], axis=1)
    tolerance = max(design.shape[1:]) * np.finfo(float).eps
    weights = np.linalg.pinv(design, rcond=tolerance) @ labels
    recent = values[:, frames - lags :, :]
    points = []
    for _ in range(horizon):
        row = np.concatenate([recent.reshape(windows, 1, -1), np.ones((windows, 1, 1))], axis=2)
        following = row @ weights
        points.append(following)
        recent = np.concatenate([recent[:, 1:, :], following], axis=1)
    result = np.concatenate(points, axis=1)
    if not np.isfinite(result).all():
        raise ValueError("autoregressive forecast is not finite")
    return result


def _batched(contexts, horizons, fit):
    """Solve windows of equal shape together; keep the batch's row order."""
    sizes = pd.DataFrame({"c": [c.shape for c in contexts], "h": horizons.to_numpy()})
    out = [None] * len(contexts)
    for (_, h), rows in sizes.groupby(["c", "h"]).groups.items():
        solved = fit(np.stack([contexts[i] for i in rows]), int(h))
        for i, points in zip(rows, solved):
            out[i] = points
    return out


def autoregression(lags, ridge=0.0):
    """AR(p) per window and channel; p = 1 stays a closed form in the JVM."""
    if lags == 1:
        return autoregression1(ridge)

    @F.pandas_udf("array<double>")
    def points(context: pd.Series, horizon: pd.Series) -> pd.Series:
        series = [np.asarray(c, dtype=float)[:, None] for c in context]
        solved = _batched(series, horizon, lambda v, h: lagged_ridge(v, h, lags, ridge))
        return pd.Series([p[:, 0] for p in solved])

    return lambda context, horizon: points(context, horizon.cast("int"))


def vector_autoregression(lags, ridge=0.0):
    """VAR(p) over all channels of a window; takes and returns nested arrays."""

    @F.pandas_udf("array<array<double>>")
    def points(contexts: pd.Series, horizon: pd.Series) -> pd.Series:
        series = [np.stack([np.asarray(c, dtype=float) for c in w], axis=1) for w in contexts]
        solved = _batched(series, horizon, lambda v, h: lagged_ridge(v, h, lags, ridge))
        return pd.Series([list(p.T) for p in solved])

    return lambda contexts, horizon: points(contexts, horizon.cast("int"))


def forecast(arrays, models):
    """F12 for per-channel models: every candidate in one pass over the rows."""
    horizon = F.col("horizon_frames")
    keep = [c for c in arrays.columns if c != "context"]
    outputs = [
        F.struct(F.lit(name).alias("model"), model(F.col("context"), horizon).alias("points"))
        for name, model in models.items()
    ]
    origin = F.element_at("context", -1).alias("origin")
    return arrays.select(*keep, origin, F.inline(F.array(*outputs)))


def forecast_channels(channels, models):
    """F12 for joint models: nested points, then one row per feature."""
    horizon = F.col("horizon_frames")
    keep = [c for c in channels.columns if c != "channels"]
    contexts = F.transform("channels", lambda c: c["context"])
    tables = []
    for name, model in models.items():
        solved = channels.withColumn("_points", model(contexts, horizon))
        rows = F.zip_with(
            "channels",
            "_points",
            lambda c, p: F.struct(
                c["feature_id"].alias("feature_id"),
                c["target"].alias("target"),
                F.element_at(c["context"], -1).alias("origin"),
                p.alias("points"),
            ),
        )
        tables.append(
            solved.select(*keep, F.lit(name).alias("model"), F.inline(rows))
        )
    return functools.reduce(lambda a, b: a.unionByName(b), tables)


def predictions(points, levels=None):
    """one row per model, window, step and feature.

    A point that is not finite stops the job. Rows keep no order; sort for output.
    """
    step = F.col("_pos") + 1
    finite = F.abs("_row.p") < F.lit(float("inf"))
    has_quantiles = "quantiles" in points.columns
    pairs = [F.col("points").alias("p"), F.col("target").alias("t")]
    if has_quantiles:
        pairs.append(F.col("quantiles").alias("q"))
    keep = [c for c in ("split",) if c in points.columns]
    rows = points.select(
        "model", *WINDOW_KEY, "system_id", "group_id", *keep, "feature_id", "origin",
        F.posexplode(F.arrays_zip(*pairs)).alias("_pos", "_row"),
    )
    if has_quantiles:
        probability = [
            F.array(*[F.lit(float(q)) for q in levels]).alias("levels"),
            F.col("_row.q").alias("quantiles"),
        ]
    else:
        probability = [
            F.lit(None).cast("array<double>").alias("levels"),
            F.lit(None).cast("array<double>").alias("quantiles"),
        ]
    return rows.select(
        "model", *WINDOW_KEY, "system_id", "group_id", *keep,
        step.alias("step"),
        "feature_id",
        (F.col("start") + F.col("context_frames") + F.col("_pos")).alias("target_frame"),
        "origin",
        F.when(finite, F.col("_row.p"))
        .otherwise(F.raise_error(F.lit("forecast point is not finite")))
        .alias("point"),
        F.col("_row.t").alias("target"),
        *probability,
    )
