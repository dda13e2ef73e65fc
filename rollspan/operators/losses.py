"""Element losses and equal-weight hierarchical means."""

import functools

from pyspark.sql import functions as F

from rollspan.functions.checked import bounded, finite, positive, required
from rollspan.operators.inference import bootstrap_ci
from rollspan.session import cut, spread
from rollspan.tables import CELL, WINDOW_KEY

POINT = (("mae", None, None), ("rmse", None, None), ("scaled-mae", None, None))


def metric_keys(levels=(), intervals=()):
    """Metric, lower and upper quantile of every loss column."""
    keys = list(POINT)
    keys += [("pinball", q, q) for q in levels]
    for lower, upper in intervals:
        if lower not in levels or upper not in levels:
            raise ValueError("interval endpoints must be forecast levels")
        keys += [("coverage", lower, upper), ("width", lower, upper)]
    return keys


def column_of(key):
    metric, lower, upper = key
    return metric if lower is None else f"{metric}-{lower}-{upper}"


def quantile_at(levels, q):
    return F.element_at("quantiles", levels.index(q) + 1)


def probability_columns(levels, intervals):
    """G4-G6 as columns: pinball, inclusive coverage and width.

    Pinball is not doubled. A row without quantiles gives nulls.
    """
    columns = {}
    for q in levels:
        error = F.col("target") - quantile_at(levels, q)
        columns[column_of(("pinball", q, q))] = F.when(
            error.isNotNull(), F.greatest(F.lit(q) * error, F.lit(q - 1) * error)
        )
    for lower, upper in intervals:
        low, high = quantile_at(levels, lower), quantile_at(levels, upper)
        columns[column_of(("coverage", lower, upper))] = (
            F.col("target").between(low, high).cast("double")
        )
        columns[column_of(("width", lower, upper))] = high - low
    return columns


def losses(predictions, scaler, levels=(), intervals=()):
    """One row per prediction with every element loss as a column.

    `rmse` holds the squared error; its root is taken at the trajectory level.
    Quantiles that decrease, losses that are not finite, features without a scale and
    scales that are not positive stop the job. The scaler holds one row per declared
    feature, so it is broadcast: the join key has few values and must not become a
    shuffle key.
    """
    metric_keys(levels, intervals)
    error = F.col("point") - F.col("target")
    rows = predictions
    if levels:
        ordered = F.col("quantiles").isNull() | (
            F.array_sort("quantiles") == F.col("quantiles")
        )
        rows = rows.withColumn(
            "quantiles",
            F.when(ordered, F.col("quantiles")).otherwise(
                F.raise_error(F.lit("a row's quantiles decrease, so it has no intervals"))
            ),
        )
    rows = rows.join(bounded(scaler.select("feature_id", "scale")), "feature_id", "left")
    scale = positive(
        required(F.col("scale"), "a feature has no scale"), "a scale is not finite and positive"
    )
    trouble = "a loss is not a finite number"
    extra = [c for c in ("split",) if c in rows.columns]
    return rows.select(
        "model", *WINDOW_KEY, "system_id", "group_id", *extra, "step", "feature_id",
        finite(F.abs(error), trouble).alias("mae"),
        finite(error * error, trouble).alias("rmse"),
        finite(F.abs(error) / scale, trouble).alias("scaled-mae"),
        *[
            finite(c, trouble).alias(n)
            for n, c in probability_columns(list(levels), intervals).items()
        ],
    )


def _metric_names(df):
    return [
        c for c in df.columns
        if c in ("mae", "rmse", "scaled-mae")
        or c.startswith(("pinball-", "coverage-", "width-"))
    ]


def with_step0(losses_rows):
    """Add the whole-horizon row, the mean of a window's per-step losses."""
    names = _metric_names(losses_rows)
    keys = [c for c in losses_rows.columns if c not in names and c != "step"]
    whole = losses_rows.groupBy(*keys).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return losses_rows.unionByName(whole.withColumn("step", F.lit(0)))


def _means(df, keys, names):
    return df.groupBy(*keys).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])


def trajectory_means(losses_rows):
    """Per-trajectory means for each step and the whole horizon, RMSE rooted.

    Every window has the same steps, so the whole-horizon mean is the mean of the
    per-step means; it is taken after the large aggregation, not beside it.
    """
    names = _metric_names(losses_rows)
    base = ["model", *CELL, "feature_id", "trajectory_id", "system_id", "group_id"]
    steps = _means(losses_rows, [*base, "step"], names)
    columns = [F.col(f"`{n}`") for n in names]
    whole = F.struct(F.lit(0).alias("step"), *[F.avg(c).alias(n) for c, n in zip(columns, names)])
    rows = steps.groupBy(*base).agg(
        F.concat(F.array(whole), F.collect_list(F.struct("step", *columns))).alias("_rows")
    )
    return rows.select(*base, F.inline("_rows")).withColumn("rmse", F.sqrt("rmse"))


def level_means(losses_rows):
    """Wide means per level, each averaging the level below with equal weights.

    Four levels read the trajectory table, so it is written out once.
    """
    return _levels(cut(trajectory_means(losses_rows)))


def _levels(trajectory, keep=lambda df: df):
    names = _metric_names(trajectory)
    base = ["model", *CELL, "feature_id", "step"]
    system = keep(_means(trajectory, [*base, "system_id", "group_id"], names))
    group = keep(_means(system, [*base, "group_id"], names))
    aggregate = _means(group, base, names)
    return {"trajectory": trajectory, "system": system, "group": group, "aggregate": aggregate}


def level_means_of_windows(points, scaler, leads):
    """`level_means` of the point losses, from window rows that hold a window's leads as arrays.

    Windows are averaged with two columns per lead, so no row per lead is made before the
    trajectory level, which is written with a row's steps in an array; the levels above are
    written too, as several tables read them. The scale divides the mean, not every error.
    What stops `group_steps` stops this.
    """
    base = ["model", *CELL, "feature_id"]
    own = [*base, "trajectory_id", "system_id", "group_id"]
    steps = range(1, leads + 1)
    rows = _fitting(points, leads).select(*own, *[lead_error(step).alias(f"_a{step}") for step in steps])
    means = rows.groupBy(*own).agg(
        *[F.avg(f"_a{step}").alias(f"_a{step}") for step in steps],
        *[F.avg(F.col(f"_a{step}") * F.col(f"_a{step}")).alias(f"_q{step}") for step in steps],
    )
    entries = [
        F.struct(F.lit(step).alias("step"), F.col(f"_a{step}").alias("mae"), F.col(f"_q{step}").alias("rmse"))
        for step in steps
    ]
    known = F.slice(F.array(*entries), F.lit(1), F.col("horizon_frames").cast("int"))
    trajectory = cut(means.select(*own, known.alias("_steps")))
    whole = F.struct(
        F.lit(0).alias("step"), *[_array_mean(F.col(f"_steps.{n}")).alias(n) for n in ("mae", "rmse")]
    )
    rows = spread(trajectory).select(*own, F.inline(F.concat(F.array(whole), F.col("_steps"))))
    mae, mse = (finite(F.col(n), "a loss is not a finite number") for n in ("mae", "rmse"))
    rows = _with_scale(rows, scaler).select(
        *own, "step", mae.alias("mae"), F.sqrt(mse).alias("rmse"), (mae / _scale()).alias("scaled-mae")
    )
    return _levels(rows, keep=cut)


def _array_mean(values):
    given = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.size(given), F.lit(0))


def _with_scale(rows, scaler):
    return rows.join(bounded(scaler.select("feature_id", "scale")), "feature_id", "left")


def _scale():
    return positive(
        required(F.col("scale"), "a feature has no scale"), "a scale is not finite and positive"
    )


def unpivot_metrics(df, keys, names):
    """Long metric rows; metrics a model does not have are left out."""
    entries = []
    for name in names:
        parts = name.rsplit("-", 2) if name not in ("mae", "rmse", "scaled-mae") else [name]
        lower, upper = (float(parts[1]), float(parts[2])) if len(parts) == 3 else (None, None)
        entries.append(
            F.struct(
                F.lit(parts[0]).alias("metric"),
                F.lit(lower).cast("double").alias("lower_q"),
                F.lit(upper).cast("double").alias("upper_q"),
                F.col(f"`{name}`").alias("value"),
            )
        )
    rows = df.select(*keys, F.inline(F.array(*entries)))
    return rows.filter(F.col("value").isNotNull())


def hierarchy(losses_rows, policy=None):
    """Metric rows for every trajectory, system, group and the aggregate.

    With a policy, aggregate rows carry the bootstrap interval over their groups in
    `ci_lower` and `ci_upper`; the other levels have none.
    """
    return hierarchy_of(level_means(losses_rows), policy)


def hierarchy_of(levels, policy=None):
    """G8 from the means of each level."""
    names = _metric_names(levels["trajectory"])
    identity = {
        "trajectory": F.col("trajectory_id"),
        "system": F.col("system_id"),
        "group": F.col("group_id"),
        "aggregate": F.lit("all"),
    }
    keys = ["model", *CELL, "level", "identity", "feature_id", "step"]
    tables = {
        level: unpivot_metrics(
            df.withColumn("level", F.lit(level)).withColumn("identity", identity[level]),
            keys,
            names,
        )
        for level, df in levels.items()
    }
    if policy is not None:
        tables = _with_intervals(tables, policy)
    return functools.reduce(lambda a, b: a.unionByName(b), tables.values())


def _with_intervals(tables, policy):
    """The levels' metric rows with interval columns; only the aggregate's few rows are joined."""
    series = ["model", "feature_id", "step", "metric", "lower_q", "upper_q"]
    groups = tables["group"].withColumnRenamed("identity", "group_id")
    bounds = bootstrap_ci(groups, series, policy).select(
        *CELL, *series, F.lit("aggregate").alias("level"),
        F.col("marginal_lower").alias("ci_lower"), F.col("marginal_upper").alias("ci_upper"),
    )
    keys = [*CELL, *series, "level"]
    matched = [F.col(f"m.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    joined = tables["aggregate"].alias("m").join(
        bounds.alias("i"), functools.reduce(lambda a, b: a & b, matched), "left"
    ).select("m.*", "i.ci_lower", "i.ci_upper")
    none = {c: F.lit(None).cast("double") for c in ("ci_lower", "ci_upper")}
    return {level: joined if level == "aggregate" else df.withColumns(none) for level, df in tables.items()}


def group_metric(losses_rows, metric="mae"):
    """Group-level values of one metric: the rows comparisons and bootstraps use."""
    base = ["model", *CELL, "feature_id", "step"]
    system = _means(trajectory_means(losses_rows), [*base, "system_id", "group_id"], [metric])
    return metric_of(_means(system, [*base, "group_id"], [metric]), metric)


def metric_of(group, metric="mae"):
    """One metric of a group level, as comparisons and bootstraps read it."""
    return group.select(
        "model", *CELL, "feature_id", "step", "group_id", F.col(f"`{metric}`").alias("value")
    )


def _at(array, step):
    return F.get(array, F.lit(step - 1))


def lead_error(step):
    """The absolute error at a lead of a row whose `points` and `target` are arrays; null beyond them."""
    return F.abs(_at("points", step) - _at("target", step))


def lead_coverage(step):
    """1 if the target at a lead lies in the interval that `with_interval` laid about its point."""
    point = _at("points", step)
    low, high = (point + F.col(f"_{side}{step}") for side in ("low", "high"))
    return _at("target", step).between(low, high).cast("double")


def _longest():
    return F.greatest(F.size("points"), F.size("target"))


def _finite_points():
    """True where every lead has a finite point; otherwise the job stops.

    One test of the whole arrays: a test per lead makes the rows' generated method so long
    that the JVM does not compile it. `array_contains` is null if the array holds a null.
    """
    infinite = F.lit(float("inf"))
    given = ~F.array_contains("points", infinite) & (F.array_max("points") < infinite)
    given = given & (F.array_min("points") > -infinite) & (F.size("points") >= F.size("target"))
    return F.when(F.coalesce(given | (_longest() <= 0), F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.lit("forecast point is not finite"))
    )


def _fitting(points, leads):
    fits = F.when(F.col("horizon_frames") <= leads, F.lit(True)).otherwise(
        F.raise_error(F.lit("a horizon is longer than the declared leads"))
    )
    return points.filter(fits).filter(_finite_points())


def with_interval(points, offsets, levels, interval, leads):
    """Window rows with the interval's offsets of every lead.

    Offsets that decrease and leads without offsets stop the job.
    """
    series = ["model", *CELL, "feature_id"]
    ordered = F.when(F.array_sort("offsets") == F.col("offsets"), F.col("offsets")).otherwise(
        F.raise_error(F.lit("a row's quantiles decrease, so it has no intervals"))
    )
    sides = {side: F.element_at(ordered, list(levels).index(q) + 1) for side, q in zip(("low", "high"), interval)}
    wide = offsets.groupBy(*series).agg(
        *[
            F.max(F.when(F.col("step") == step, offset)).alias(f"_{side}{step}")
            for step in range(1, leads + 1) for side, offset in sides.items()
        ]
    )
    lost = [
        F.when(F.col(f"_low{step}").isNull() | F.col(f"_high{step}").isNull(), step - 1) for step in range(1, leads + 1)
    ]
    wide = wide.withColumn("_given", F.least(*lost, F.lit(leads)))
    known = F.when(F.coalesce("_given", F.lit(0)) >= F.least(_longest(), F.lit(leads)), F.lit(True)).otherwise(
        F.raise_error(F.lit("a prediction has no residual offsets"))
    )
    return points.join(bounded(wide), series, "left").filter(known).drop("_given")


def group_steps(points, element, leads, scaler=None):
    """Group values per step and over the whole horizon (step 0), from window rows.

    `element(step)` is a loss at one lead of a row that holds a window's leads as arrays;
    windows, trajectories, systems and groups are averaged with a column per lead, so no
    row per lead is made or shuffled. `leads` is the grid's longest horizon; a longer one
    stops the job, as do a point that is not finite and a trajectory whose mean is not. With
    a scaler, a feature without a scale stops it too.
    """
    base = ["model", *CELL, "feature_id"]
    names = [f"_s{step}" for step in range(1, leads + 1)]
    if scaler is not None:
        points = _with_scale(points, scaler).filter(_scale() > 0)
    rows = _fitting(points, leads).select(
        *base, "trajectory_id", "system_id", "group_id",
        *[element(step).alias(n) for step, n in enumerate(names, start=1)],
    )
    trajectory = _means(rows, [*base, "trajectory_id", "system_id", "group_id"], names)
    trajectory = trajectory.withColumns({n: finite(F.col(n), "a loss is not a finite number") for n in names})
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in names])
    known = functools.reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("double") for n in names])
    trajectory = trajectory.withColumn("_s0", total / F.nullif(known, F.lit(0.0)))
    system = _means(trajectory, [*base, "system_id", "group_id"], ["_s0", *names])
    group = _means(system, [*base, "group_id"], ["_s0", *names])
    steps = [
        F.struct(F.lit(step).alias("step"), F.col(f"_s{step}").alias("value")) for step in range(leads + 1)
    ]
    out = group.select(*base, "group_id", F.inline(F.array(*steps)))
    return out.filter(F.col("step") <= F.col("horizon_frames")).select(*base, "step", "group_id", "value")


def aggregate_rows(groups, metric, lower_q=None, upper_q=None):
    """G8's aggregate rows of one metric from group values per step."""
    base = ["model", *CELL, "feature_id", "step"]
    return groups.groupBy(*base).agg(F.avg("value").alias("value")).select(
        *base[:3], F.lit("aggregate").alias("level"), F.lit("all").alias("identity"), *base[3:],
        F.lit(metric).alias("metric"), F.lit(lower_q).cast("double").alias("lower_q"),
        F.lit(upper_q).cast("double").alias("upper_q"), "value",
    ).filter(F.col("value").isNotNull())


def group_mae(predictions, extra=()):
    """Trajectory then group MAE, no system level, with counts."""
    error = F.abs(F.col("point") - F.col("target"))
    return _group_mae(predictions, extra, F.avg(error), F.count_if(F.col("step") == 1))


def group_mae_of_windows(points, extra=()):
    """G9 from forecast rows that hold a window's points and targets as arrays.

    A window's errors are added up in its row, so no row per lead is made. A point that is
    not finite stops the job, as in `predictions`; leads without a target are left out.
    """
    add = lambda errors: F.aggregate(errors, F.lit(0.0), lambda a, x: a + x)
    rows = points.withColumn("_errors", F.zip_with("points", "target", lambda p, t: F.abs(p - t)))
    rows = rows.withColumn("_sum", add(F.col("_errors")))
    plain = F.coalesce(F.abs("_sum") < F.lit(float("inf")), F.lit(False))
    given = F.filter("_errors", lambda x: x.isNotNull())
    finite = F.forall("points", lambda p: F.coalesce(F.abs(p) < F.lit(float("inf")), F.lit(False)))
    unfit = F.raise_error(F.lit("forecast point is not finite")).cast("double")
    rows = rows.withColumns({
        "_total": F.when(plain, F.col("_sum")).when(finite, add(given)).otherwise(unfit),
        "_known": F.when(plain, F.size("_errors")).otherwise(F.size(given)).cast("double"),
    })
    mean = F.sum("_total") / F.nullif(F.sum("_known"), F.lit(0.0))
    return _group_mae(rows, extra, mean, F.count_if(F.size("points") > 0))


def _group_mae(rows, extra, mae, windows):
    base = ["model", *CELL, "feature_id", *extra]
    trajectory = rows.groupBy(*base, "group_id", "trajectory_id").agg(
        mae.alias("mae"), windows.alias("windows")
    )
    return trajectory.groupBy(*base, "group_id").agg(
        F.avg("mae").alias("mae"),
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("windows").alias("windows"),
    )


def normalized_score(group_rows, scaler):
    """Mean over groups and features of MAE divided by the TRAIN scale."""
    scale = positive(
        required(F.col("scale"), "a feature has no scale"), "a scale is not finite and positive"
    )
    return (
        group_rows.join(bounded(scaler.select("feature_id", "scale")), "feature_id", "left")
        .groupBy("model", *CELL)
        .agg(F.avg(F.col("mae") / scale).alias("score"))
    )
