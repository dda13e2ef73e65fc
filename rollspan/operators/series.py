"""Quality control and dependence of ordered series.

Rows are shuffled by (trajectory, feature, block); each block carries the frames it
looks back to, so lags never gather a whole trajectory.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions import blocks as blk
from rollspan.functions.arrays import total
from rollspan.functions.blocks import over_blocks, with_blocks
from rollspan.functions.quantiles import exact_quantiles
from rollspan.operators.inference import bootstrap_ci
from rollspan.session import cut
from rollspan.tables import feature_columns

DECAY_LEVEL = math.exp(-1)
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
SERIES = ["trajectory_id", "feature_id"]


def long_frames(frames, features=None):
    """One row per trajectory, frame and feature."""
    features = features or feature_columns(frames)
    return frames.unpivot(["trajectory_id", "frame"], features, "feature_id", "value")


def _in_block():
    return Window.partitionBy(*SERIES, "block").orderBy("frame")


def block_summaries(frames, max_lag, features=None):
    """One mergeable row per series and block, from one pass over the frames.

    About `level`, the block's first value (the look-back included), u = value - level:
    count, extremes, sums of u, u^2 and of frame terms about the block's first frame;
    per lag k the pairs' count c, sum of products p and sum of both members w; the
    increments about the block's first one. Pairs and increments belong to the block of
    their later frame, which carries the frames it looks back to, so summaries of
    neighbouring blocks add up.
    """
    rows = with_blocks(long_frames(frames, features), before=max(max_lag, 1)).repartition(*SERIES, "block")
    block, u = _in_block(), F.col("value") - F.col("level")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("level", F.first("value").over(upto)).withColumn("u", u)
    step = F.col("value") - F.lag("value").over(block)
    lagged = known.select(
        *SERIES, "block", "frame", "own", "value", "level", "u", step.alias("d"),
        *[F.lag("u", k).over(block).alias(f"l{k}") for k in range(1, max_lag + 1)],
    ).filter("own")
    origin = F.col("block") * blk.BLOCK
    at = (F.col("frame") - origin).cast("double")
    first = F.min_by("d", F.when(F.col("d").isNotNull(), F.col("frame"))).over(
        Window.partitionBy(*SERIES, "block")
    )
    lagged = lagged.withColumn("at", at).withColumn("e", first).withColumn("g", F.col("d") - F.col("e"))
    lags = range(1, max_lag + 1)
    return lagged.groupBy(*SERIES, "block").agg(
        F.first("level").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"),
        F.sum("at").alias("t"), F.sum(F.col("at") * F.col("at")).alias("tt"),
        F.sum(F.col("at") * F.col("u")).alias("tu"),
        F.array(*[F.count(f"l{k}") for k in lags]).alias("c") if max_lag else F.array().cast("array<long>").alias("c"),
        F.array(*[F.coalesce(F.sum(F.col("u") * F.col(f"l{k}")), F.lit(0.0)) for k in lags]).cast("array<double>").alias("p"),
        F.array(*[F.coalesce(F.sum(F.col("u") + F.col(f"l{k}")), F.lit(0.0)) for k in lags]).cast("array<double>").alias("w"),
        F.first("e").alias("e"), F.count("d").alias("k"),
        F.min("d").alias("d_low"), F.max("d").alias("d_high"),
        F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("gg"),
    )


def merged_summaries(blocks, max_lag):
    """The summaries of a series' blocks as one: moments, drift, lag sums, increments.

    Levels are shifted to the series' mean before anything is added, so nothing large
    cancels. A constant has exactly zero deviation, drift and lag sums.
    """
    blocks = cut(blocks)
    start = F.col("block") * blk.BLOCK
    centres = blocks.groupBy(*SERIES).agg(
        F.sum("n").alias("_n"),
        F.sum("k").alias("_k"),
        (F.sum(F.col("s") + F.col("n") * F.col("level")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("t") + F.col("n") * start) / F.sum("n")).alias("_f"),
        (F.sum(F.col("g") + F.col("k") * F.col("e")) / F.sum("k")).alias("step_mean"),
        (F.min("low") == F.max("high")).alias("constant"),
        (F.min("d_low") == F.max("d_high")).alias("_even"),
    )
    shift, late, rise = F.col("level") - F.col("mean"), start - F.col("_f"), F.col("e") - F.col("step_mean")
    lag = lambda k: (
        F.get("p", k) + shift * F.get("w", k) + F.get("c", k) * shift * shift
    )
    sums = blocks.join(centres, SERIES).groupBy(*SERIES).agg(
        *[F.first(c).alias(c) for c in ("_n", "_k", "mean", "step_mean", "constant", "_even")],
        F.sum("missing").alias("missing"),
        F.sum(F.col("q") + 2 * shift * F.col("s") + F.col("n") * shift * shift).alias("_s0"),
        F.sum(F.col("tu") + late * F.col("s") + shift * F.col("t") + F.col("n") * late * shift).alias("_xy"),
        F.sum(F.col("tt") + 2 * late * F.col("t") + F.col("n") * late * late).alias("_xx"),
        F.sum(F.col("gg") + 2 * rise * F.col("g") + F.col("k") * rise * rise).alias("_gg"),
        F.array(*[F.sum(lag(F.lit(k))) for k in range(max_lag)]).cast("array<double>").alias("_lags"),
    )
    varies = lambda column: F.when(F.col("constant"), 0.0).otherwise(column)
    return sums.select(
        *SERIES,
        F.col("_n").alias("n"),
        "missing", "mean", "constant",
        varies(F.sqrt(F.greatest(F.col("_s0"), F.lit(0.0)) / F.col("_n"))).alias("std"),
        varies(F.col("_xy") / F.nullif(F.col("_xx"), F.lit(0.0))).alias("drift"),
        F.when(
            ~F.col("constant") & (F.col("_s0") > 0),
            F.slice(
                F.concat(F.array(F.lit(1.0)), F.transform("_lags", lambda v: v / F.col("_s0"))),
                F.lit(1),
                F.least(F.lit(max_lag + 1), F.col("_n")).cast("int"),
            ),
        ).alias("acf"),
        "step_mean",
        F.when(F.col("_even"), 0.0).otherwise(F.sqrt(F.col("_gg") / F.col("_k"))).alias("step_std"),
        F.col("_k").alias("increments"),
    )


def acf(frames, max_lag, features=None):
    """Q2: autocorrelation with a global mean and the lag-0 sum as denominator.

    Lags run to min(max_lag, T - 1); a constant series has a null curve.
    """
    merged = merged_summaries(block_summaries(frames, max_lag, features), max_lag)
    return merged.select(*SERIES, "n", "acf")


def _first_lag(curve, test):
    """Smallest lag from 1 whose autocorrelation passes `test`, or null."""
    lags = F.when(F.size(curve) > 1, F.sequence(F.lit(1), F.size(curve) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.get(F.filter(lags, lambda k: test(F.get(curve, k))), 0)


def decay(curves):
    """Q3: first lag at or below 1/e; else censored; a constant is neither."""
    crossing = _first_lag(F.col("acf"), lambda r: r <= DECAY_LEVEL)
    return curves.withColumn("decay_frames", crossing).withColumn(
        "decay_censored", F.col("acf").isNotNull() & F.col("decay_frames").isNull()
    )


def correlation_times(curves, max_lag):
    """Q9: decay capped at max_lag, positive integrated ACF and the censored flag."""
    decayed = decay(curves).filter(F.col("acf").isNotNull())
    stop = _first_lag(F.col("acf"), lambda r: r <= 0)
    length = F.coalesce(stop - 1, F.size("acf") - 1)
    return decayed.select(
        *SERIES, "n", "acf",
        F.coalesce("decay_frames", F.lit(max_lag)).alias("decay"),
        (F.lit(0.5) + total(F.slice("acf", F.lit(2), length))).alias("integrated"),
        F.col("decay_censored").alias("censored"),
    )


def feature_qc(frames, cutoffs, max_lag, event_sigma):
    """Q1-Q6: distribution, dependence, drift, half shift and jumps per series.

    One pass makes block summaries, which merge to moments, lags and increments; with
    those known a second pass splits the halves and counts the jumps. Quantiles have
    passes of their own. `cutoffs` gives the near-constant deviation per feature.
    """
    features = list(cutoffs)
    merged = cut(merged_summaries(block_summaries(frames, max_lag, features), max_lag))
    quantiles = exact_quantiles(long_frames(frames, features), SERIES, "value", QUANTILES, "quantiles")
    events = _halves_and_jumps(long_frames(frames, features), merged, event_sigma)
    lookup = F.create_map(*[F.lit(x) for k, v in cutoffs.items() for x in (k, float(v))])
    joined = decay(merged).join(quantiles, SERIES, "left").join(events, SERIES, "left")
    return joined.select(
        *SERIES, "n", "missing", "quantiles", "mean",
        (F.col("std") * F.col("std")).alias("variance"),
        "std", "constant",
        (F.col("std") <= lookup[F.col("feature_id")]).alias("near_constant"),
        "acf", "decay_frames", "decay_censored", "drift",
        F.when(~F.col("constant"), (F.col("later") - F.col("earlier")) / F.col("std")).alias(
            "half_shift"
        ),
        F.when(F.col("increments") > 0, F.col("jumps")).alias("jumps"),
        F.when(F.col("increments") > 0, F.col("increments")).alias("increments"),
    )


def _halves_and_jumps(rows, merged, event_sigma):
    """Q5 and Q6: means before and from frame T div 2; increments further than
    `event_sigma` population deviations from their mean."""
    known = over_blocks(merged.select(*SERIES, "n", "step_mean", "step_std"), F.col("n"))
    steps = (
        with_blocks(rows, before=1)
        .repartition(*SERIES, "block")
        .withColumn("d", F.col("value") - F.lag("value").over(_in_block()))
        .filter("own")
        .join(known, [*SERIES, "block"])
    )
    late = F.col("frame") >= F.floor(F.col("n") / 2)
    far = (F.col("step_std") > 0) & (F.abs(F.col("d") - F.col("step_mean")) > event_sigma * F.col("step_std"))
    return steps.groupBy(*SERIES).agg(
        F.avg(F.when(~late, F.col("value"))).alias("earlier"),
        F.avg(F.when(late, F.col("value"))).alias("later"),
        F.count_if(far).alias("jumps"),
    )


def cross_correlation(frames, features=None):
    """Q7: zero-lag Pearson matrix per trajectory from one aggregate, no self join."""
    features = features or feature_columns(frames)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    aggregates = [F.min(f).alias(f"_lo_{f}") for f in features]
    aggregates += [F.max(f).alias(f"_hi_{f}") for f in features]
    aggregates += [F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    aggregates += [F.covar_pop(a, b).alias(f"_c_{a}_{b}") for a, b in pairs if a != b]
    wide = frames.groupBy("trajectory_id").agg(*aggregates)
    entries = []
    for a, b in pairs:
        varies = (F.col(f"_lo_{a}") < F.col(f"_hi_{a}")) & (F.col(f"_lo_{b}") < F.col(f"_hi_{b}"))
        if a == b:
            value = F.when(varies, 1.0)
        else:
            norm = F.nullif(F.col(f"_s_{a}") * F.col(f"_s_{b}"), F.lit(0.0))
            value = F.when(varies, F.col(f"_c_{a}_{b}") / norm)
        for left, right in {(a, b), (b, a)}:
            entries.append(
                F.struct(
                    F.lit(left).alias("feature_a"),
                    F.lit(right).alias("feature_b"),
                    value.alias("correlation"),
                )
            )
    return wide.select("trajectory_id", F.inline(F.array(*entries)))


def dependence_summary(curves, groups, max_lag, policy):
    """Q8: replica curves averaged per group, then equal groups with intervals.

    Long result: one row per feature, measure and lag. Constants are counted and
    left out; a feature whose series are all constant keeps one row with its counts and
    no measure. A series must be longer than max_lag.
    """
    ready = curves.withColumn(
        "acf",
        F.when(F.col("n") > max_lag, F.col("acf")).otherwise(
            F.raise_error(F.lit("dependence needs series longer than the lag limit"))
        ),
    )
    counts = ready.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.count_if(F.col("acf").isNull()).alias("constant_trajectories"),
    )
    times = correlation_times(ready, max_lag).join(
        groups.select("trajectory_id", "group_id"), "trajectory_id"
    )
    plain = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.lit(-1).alias("lag"), v.alias("value"))
            for m, v in (
                ("decay", F.col("decay").cast("double")),
                ("integrated", F.col("integrated")),
                ("censored", F.col("censored").cast("double")),
            )
        ]
    )
    lags = F.transform(
        "acf",
        lambda r, k: F.struct(
            F.lit("acf").alias("measure"), k.alias("lag"), r.alias("value")
        ),
    )
    group = (
        times.select("feature_id", "group_id", F.inline(F.concat(lags, plain)))
        .groupBy("feature_id", "group_id", "measure", "lag")
        .agg(F.avg("value").alias("value"))
    )
    out = bootstrap_ci(group, ["measure", "lag"], policy, population=["feature_id"])
    shown = F.col("measure") != "censored"
    return counts.join(out, "feature_id", "left").select(
        "feature_id", "measure", "lag",
        F.col("mean").alias("value"),
        F.when(shown, F.col("marginal_lower")).alias("ci_lower"),
        F.when(shown, F.col("marginal_upper")).alias("ci_upper"),
        F.coalesce("groups", F.lit(0)).alias("groups"),
        "trajectories", "constant_trajectories",
    )
