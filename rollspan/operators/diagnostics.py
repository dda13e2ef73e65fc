"""Forecast diagnostics and confirmation summaries."""

import functools

from pyspark.sql import functions as F

from rollspan.functions.arrays import deviations, mean, non_decreasing, total
from rollspan.functions.checked import bounded
from rollspan.operators.inference import bootstrap_ci
from rollspan.operators.losses import probability_columns
from rollspan.session import cut
from rollspan.tables import CELL, WINDOW_KEY

ERRORS = {
    "lead_absolute_error": "mae",
    "lead_squared_error": "rmse",
    "lead_bias": "bias",
}


def _spread(values):
    return F.sqrt(total(F.transform(deviations(values), lambda d: d * d)) / F.size(values))


def forecast_diagnostics(points):
    """G17, per window and feature, straight from the arrays.

    Spread is the population deviation after the first value is subtracted, so a
    constant horizon has exactly zero spread and a null ratio.
    """
    error = F.zip_with("points", "target", lambda p, y: p - y)
    rows = points.withColumn("_e", error)
    absolute = mean(F.transform("_e", F.abs))
    keep = [c for c in points.columns if c not in ("points", "target", "origin", "quantiles")]
    return rows.select(
        *keep,
        _spread(F.col("points")).alias("predicted_std"),
        _spread(F.col("target")).alias("actual_std"),
        mean(F.col("_e")).alias("mean_bias"),
        absolute.alias("mae"),
        F.sqrt(mean(F.transform("_e", lambda e: e * e))).alias("rmse"),
        (mean(F.col("points")) - F.col("origin")).alias("predicted_change_from_origin"),
        (mean(F.col("target")) - F.col("origin")).alias("actual_change_from_origin"),
    ).withColumn(
        "spread_ratio", F.col("predicted_std") / F.nullif("actual_std", F.lit(0.0))
    ).withColumn("change_from_origin_mae", F.col("mae"))


def tag_crossings(predictions, cell=("model", *CELL, "feature_id")):
    """Flag decreasing quantiles; one crossing fails the whole cell.

    The per-cell verdict has one row per declared model, cell and feature and is
    broadcast back; points are all kept.
    """
    tagged = predictions.withColumn("quantiles_valid", non_decreasing(F.col("quantiles")))
    cells = tagged.groupBy(*cell).agg(F.bool_and("quantiles_valid").alias("cell_valid"))
    return tagged.join(bounded(cells), list(cell))


def crossing_status(tagged, cell=("model", *CELL, "feature_id")):
    """Points, crossing points and windows touched, per cell."""
    crossing = ~F.col("quantiles_valid")
    window = F.struct("trajectory_id", "start")
    return tagged.groupBy(*cell).agg(
        F.bool_and("quantiles_valid").alias("valid"),
        F.when(F.bool_and("quantiles_valid"), "ordered")
        .otherwise("invalid-crossing-quantiles")
        .alias("status"),
        F.count(F.lit(1)).alias("total_points"),
        F.count_if(crossing).alias("crossing_points"),
        F.count_distinct(F.when(crossing, window)).alias("affected_windows"),
    )


def _lead_columns(levels, intervals, shown=None):
    """Errors, then probability losses (where `shown` holds), as columns."""
    error = F.col("point") - F.col("target")
    return [
        error.alias("lead_bias"),
        F.abs(error).alias("lead_absolute_error"),
        (error * error).alias("lead_squared_error"),
        *[
            (c if shown is None else F.when(shown, c)).alias(n)
            for n, c in probability_columns(list(levels), intervals).items()
        ],
    ]


def lead_table(tagged, levels, intervals):
    """Per-lead errors, and probability losses where the cell's quantiles are ordered."""
    return tagged.select(
        "model", *WINDOW_KEY, "system_id", "group_id", "feature_id",
        F.col("step").alias("lead"),
        *_lead_columns(levels, intervals, F.col("cell_valid")),
    )


def _probability_names(df):
    return [c for c in df.columns if c.startswith(("pinball-", "coverage-", "width-"))]


def _avg(names):
    return [F.avg(F.col(f"`{n}`")).alias(n) for n in names]


def system_metrics(leads, keys=("model", *CELL, "feature_id"), tag=None):
    """Trajectory then group means; RMSE rooted per trajectory; mean pinball.

    `tag` names a boolean column that holds for a group if it holds for all its rows.
    """
    keys = list(keys)
    names = [*ERRORS, *_probability_names(leads)]
    tags = [F.bool_and(tag).alias(tag)] if tag else []
    trajectory = leads.groupBy(*keys, "group_id", "trajectory_id").agg(*_avg(names), *tags)
    rooted = trajectory.withColumn("lead_squared_error", F.sqrt("lead_squared_error"))
    group = rooted.groupBy(*keys, "group_id").agg(*_avg(names), *tags).withColumnsRenamed(ERRORS)
    pinball = [F.col(f"`{n}`") for n in names if n.startswith("pinball-")]
    if pinball:
        group = group.withColumn(
            "mean-pinball", functools.reduce(lambda a, b: a + b, pinball) / len(pinball)
        )
    return group


def tagged_system_metrics(predictions, levels, intervals):
    """G21 and G22 in one pass: `system_metrics` of the `lead_table` of tagged predictions.

    Whether quantiles are ordered is gathered with the means, so a cell's verdict comes
    from its group rows, which are written once; the predictions are read once.
    """
    cell = ["model", *CELL, "feature_id"]
    leads = predictions.select(
        *cell, "group_id", "trajectory_id",
        *_lead_columns(levels, intervals), non_decreasing(F.col("quantiles")).alias("_ordered"),
    )
    groups = cut(system_metrics(leads, cell, "_ordered"))
    cells = groups.groupBy(*cell).agg(F.bool_and("_ordered").alias("_valid"))
    probability = [*_probability_names(groups), *(["mean-pinball"] if "mean-pinball" in groups.columns else [])]
    shown = {n: F.when(F.col("_valid"), F.col(f"`{n}`")) for n in probability}
    return groups.join(bounded(cells), cell).withColumns(shown).drop("_ordered", "_valid")


def error_summary(leads, by_lead=False):
    """MAE, RMSE and bias, trajectory to group to all."""
    keys = ["model", *CELL, "feature_id", *(["lead"] if by_lead else [])]
    group = system_metrics(leads.select(*keys, "group_id", "trajectory_id", *ERRORS), keys)
    out = group.groupBy(*keys).agg(*_avg(["mae", "rmse", "bias"]))
    return out if by_lead else out.withColumn("lead", F.lit(0))


def spread_summary(diagnostics):
    """Hierarchical spread means, windows and undefined ratios."""
    keys = ["model", *CELL, "feature_id"]
    names = [
        "predicted_std", "actual_std", "spread_ratio",
        "predicted_change_from_origin", "actual_change_from_origin",
    ]
    trajectory = diagnostics.groupBy(*keys, "group_id", "trajectory_id").agg(
        *_avg(names),
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("spread_ratio").isNull()).alias("undefined_spread_ratios"),
    )
    sums = [F.sum(c).alias(c) for c in ("windows", "undefined_spread_ratios")]
    group = trajectory.groupBy(*keys, "group_id").agg(*_avg(names), *sums)
    return group.groupBy(*keys).agg(*_avg(names), *sums)


def _melt(group, keys, names):
    entries = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]
    )
    return group.select(*keys, "group_id", F.inline(entries)).filter(F.col("value").isNotNull())


def probability_summary(leads, policy, by_lead=False):
    """Pinball, coverage and width with group intervals, whole or per lead."""
    keys = ["model", *CELL, "feature_id", *(["lead"] if by_lead else [])]
    names = _probability_names(leads)
    trajectory = leads.groupBy(*keys, "group_id", "trajectory_id").agg(*_avg(names))
    group = trajectory.groupBy(*keys, "group_id").agg(*_avg(names))
    series = [k for k in keys if k not in CELL] + ["metric"]
    out = bootstrap_ci(_melt(group, keys, names), series, policy)
    return out if by_lead else out.withColumn("lead", F.lit(0))


def decide(effects, nominal, tolerance):
    """Decision booleans from effect bounds; a null bound never passes.

    `effects` has rows (keys..., kind, reference, ci_lower, ci_upper) with kinds
    mae, worthwhile, pinball, width and coverage.
    """
    keys = [
        c for c in effects.columns
        if c not in ("kind", "reference", "difference", "ci_lower", "ci_upper", "groups", "status")
    ]
    below = F.coalesce(F.col("ci_upper") < 0, F.lit(False))

    def rule(kind, reference, passed=below):
        chosen = (F.col("kind") == kind) & (
            (F.col("reference") == reference) if reference else F.lit(True)
        )
        return F.coalesce(F.bool_and(F.when(chosen, passed)), F.lit(False))

    def both(kind):
        return rule(kind, "persistence") & rule(kind, "selected-statistic")

    inside = F.coalesce(
        (F.col("ci_lower") >= nominal - tolerance) & (F.col("ci_upper") <= nominal + tolerance),
        F.lit(False),
    )
    not_wider = F.coalesce(F.col("ci_upper") <= 0, F.lit(False))
    flags = effects.groupBy(*keys).agg(
        both("mae").alias("measurable_point_gain"),
        both("worthwhile").alias("worthwhile_point_gain"),
        both("pinball").alias("pinball_gain"),
        rule("coverage", None, inside).alias("calibrated"),
        rule("width", None, not_wider).alias("width_not_worse"),
        rule("worthwhile", "compact").alias("_stronger"),
    )
    useful = functools.reduce(
        lambda a, b: a & b,
        [F.col(c) for c in (
            "measurable_point_gain", "worthwhile_point_gain", "pinball_gain",
            "calibrated", "width_not_worse",
        )],
    )
    return flags.withColumn("useful_minimum", useful).withColumn(
        "useful_stronger", useful & F.col("_stronger")
    ).drop("_stronger")


def task_effects(groups, method, references, policy, reduction, interval=(0.1, 0.9)):
    """The fixed family of effects of one method against its references.

    `groups` is the output of `system_metrics`; `references` maps each role
    (persistence, selected-statistic, compact) to a model. All models of a group come
    together in one aggregate, and group differences of all kinds go through one
    bootstrap, so the draws are made once.
    """
    keys = [*CELL, "feature_id"]
    low, high = interval
    coverage, width = f"coverage-{low}-{high}", f"width-{low}-{high}"
    mine = groups.filter(F.col("model") == method)
    factor = 1 - reduction
    wanted = [("mae", r, "mae", 1.0) for r in references]
    wanted += [("worthwhile", r, "mae", factor) for r in references]
    wanted += [("pinball", r, "mean-pinball", 1.0) for r in references if r != "compact"]
    wanted += [("width", "selected-statistic", width, 1.0)]
    used = sorted({metric for _, _, metric, _ in wanted} | {coverage})
    metrics = F.struct(*[F.col(f"`{m}`").alias(m) for m in used])
    models = {"none": method, **references}
    beside = groups.filter(F.col("model").isin(*models.values())).groupBy(*keys, "group_id").agg(
        *[F.first(F.when(F.col("model") == m, metrics), ignorenulls=True).alias(f"_{role}") for role, m in models.items()]
    )
    whole = functools.reduce(lambda x, y: x & y, [F.col(f"`_{role}`").isNotNull() for role in models])
    stop = F.raise_error(F.lit("paired groups differ"))
    entries = [
        F.struct(
            F.lit(role).alias("reference"),
            F.lit(kind).alias("kind"),
            (F.col("_none")[metric] - F.lit(scale) * F.col(f"`_{role}`")[metric]).alias("value"),
        )
        for kind, role, metric, scale in wanted
    ]
    entries.append(
        F.struct(
            F.lit("none").alias("reference"), F.lit("coverage").alias("kind"),
            F.col("_none")[coverage].alias("value"),
        )
    )
    values = cut(
        beside.select(
            *keys, F.when(whole, F.col("group_id")).otherwise(stop).alias("group_id"), F.inline(F.array(*entries))
        )
    )
    failed = values.filter(F.col("value").isNull()).select(*keys, "kind", "reference").distinct()
    scored = bootstrap_ci(
        values.filter(F.col("value").isNotNull()), ["feature_id", "kind", "reference"], policy
    )
    kept = scored.select(
        *keys, "kind", "reference",
        F.col("mean").alias("difference"),
        F.col("corrected_lower").alias("ci_lower"),
        F.col("corrected_upper").alias("ci_upper"),
        "groups",
        F.col("corrected_status").alias("status"),
    )
    missing = failed.select(
        *keys, "kind", "reference",
        *[F.lit(None).cast("double").alias(c) for c in ("difference", "ci_lower", "ci_upper")],
        F.lit(None).cast("long").alias("groups"),
        F.lit("invalid-crossing-quantiles").alias("status"),
    )
    return kept.unionByName(missing).withColumn("method", F.lit(method))


def summarize_task(groups, policy, references):
    """Per cell, feature and method, mean metrics, intervals and MAE ratios."""
    keys = ["model", *CELL, "feature_id"]
    groups = cut(groups)
    names = [c for c in groups.columns if c not in (*keys, "group_id")]
    means = bootstrap_ci(
        _melt(groups, keys, names), ["model", "feature_id", "metric"], policy
    )
    mae = groups.groupBy(*keys).agg(F.avg("mae").alias("_mae"))
    ratios = mae
    for role, model in references.items():
        base = mae.filter(F.col("model") == model).select(
            *CELL, "feature_id", F.col("_mae").alias("_base")
        )
        ratios = ratios.join(base, [*CELL, "feature_id"], "left").withColumn(
            f"ratio_{role}", F.col("_mae") / F.nullif("_base", F.lit(0.0))
        ).drop("_base")
    return means.join(ratios.drop("_mae"), keys)


def choose_inputs(group_rows, policy):
    """Seed-averaged effects and, per target, the input condition to keep.

    `group_rows`: target, seed, condition, group_id, mae. `joint` wins only when it
    is strictly below both alternatives.
    """
    averaged = group_rows.groupBy("target", "condition", "group_id").agg(
        F.avg("mae").alias("value")
    )
    means = group_rows.groupBy("target", "condition", "seed").agg(F.avg("mae").alias("m"))
    wide = means.groupBy("target").pivot("condition", ["target-only", "joint", "shifted"]).agg(
        F.avg("m")
    )
    choice = F.when(
        F.col("joint") < F.least("target-only", "shifted"), "joint"
    ).otherwise("target-only")
    one = lambda c: F.first(F.when(F.col("condition") == c, F.col("value")), ignorenulls=True)
    beside = averaged.groupBy("target", "group_id").agg(
        one("target-only").alias("_base"), one("joint").alias("_joint"), one("shifted").alias("_shifted")
    )
    whole = F.col("_base").isNotNull() & F.col("_joint").isNotNull() & F.col("_shifted").isNotNull()
    stop = F.raise_error(F.lit("paired groups are unmatched"))
    values = beside.select(
        "target",
        F.when(whole, F.col("group_id")).otherwise(stop).alias("group_id"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("condition"), (F.col(f"_{c}") - F.col("_base")).alias("value"))
                    for c in ("joint", "shifted")
                ]
            )
        ),
    )
    effects = bootstrap_ci(values, ["condition"], policy, ["target"]).select(
        "target", "condition", F.col("mean").alias("difference"), "marginal_lower", "marginal_upper", "groups"
    )
    return effects.join(wide.select("target", choice.alias("choice")), "target")


def trial_summary(scores):
    """Mean and sample deviation per setting; lowest mean, then setting, wins."""
    rows = scores.groupBy("setting").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("seed_std")
    )
    best = rows.agg(F.min_by("setting", F.struct("mean", "setting"))).scalar()
    return rows.select("setting", "mean", "seed_std", (F.col("setting") == best).alias("selected"))
