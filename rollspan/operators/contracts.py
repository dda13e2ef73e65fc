"""Contracts of the canonical tables.

Each check returns its violations as rows (rule, key); an empty result passes.
"""

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions.arrays import non_decreasing
from rollspan.functions.blocks import over_blocks, with_blocks
from rollspan.operators.scaling import in_regions
from rollspan.operators.windows import ATOL, PS_PER_NS, RTOL, reached_before, resolve_grid
from rollspan.session import cut
from rollspan.tables import CELL, ROLE_SPLITS, WINDOW_KEY, feature_columns


def violations(df, key, rules):
    """One row per rule a record breaks; an unknown condition counts as broken."""
    broken = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def merge(*tables):
    return functools.reduce(lambda a, b: a.unionByName(b), tables)


def counted(found):
    """Violations per rule."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def _apart(value, expected):
    """Not close: |value - expected| > atol + rtol * |expected|."""
    return F.abs(value - expected) > F.lit(ATOL) + F.lit(RTOL) * F.abs(expected)


def _unfit(columns):
    tests = [
        F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns
    ]
    return functools.reduce(lambda a, b: a | b, tests)


def validate_frames(frames, trajectories, features=None):
    """V1: finite values, dense frames, increasing time and the declared axis.

    Successive frames are compared inside blocks that carry one earlier frame.
    """
    features = features or feature_columns(frames)
    before = Window.partitionBy("trajectory_id", "block").orderBy("frame")
    meta = over_blocks(
        trajectories.select("trajectory_id", "frame_count", "frame_interval_ps", "time_unit"),
        F.col("frame_count"),
    )
    factor = F.when(F.col("time_unit") == "ns", PS_PER_NS).otherwise(1.0)
    rows = (
        with_blocks(frames.select("trajectory_id", "frame", "time", *features), before=1)
        .withColumn("_step", F.col("time") - F.lag("time").over(before))
        .withColumn("_gap", F.col("frame") - F.lag("frame").over(before))
        .filter("own")
        .join(meta, ["trajectory_id", "block"], "left")
    )
    seen = rows.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame").alias("first"),
        F.max("frame").alias("last"),
        F.max(F.when(F.col("frame") == 0, F.col("time"))).alias("origin"),
        F.max_by("time", "frame").alias("end"),
        F.count_if(_unfit(["time", *features])).alias("unfit"),
        F.count_if(F.col("_gap") != 1).alias("gaps"),
        F.count_if(~(F.col("_step") > 0)).alias("backward"),
        F.count_if(F.col("time") != F.col("frame")).alias("off_axis"),
        F.count_if(_apart(F.col("_step"), F.col("frame_interval_ps") / factor)).alias("uneven"),
    )
    joined = trajectories.drop("split").join(seen, "trajectory_id", "full_outer")
    physical = F.col("time_unit") != "frame"
    ns = F.col("end") / F.when(F.col("time_unit") == "ps", PS_PER_NS).otherwise(1.0)
    return violations(
        joined,
        F.col("trajectory_id"),
        {
            "frame-count": F.col("n") != F.col("frame_count"),
            "frame-order": (F.col("first") != 0)
            | (F.col("last") != F.col("n") - 1)
            | (F.col("gaps") > 0),
            "finite": F.col("unfit") > 0,
            "time-origin": F.col("origin") != 0,
            "time-order": F.col("backward") > 0,
            "frame-axis": ~physical & (F.col("off_axis") > 0),
            "duration": physical & _apart(ns, F.col("duration_ns")),
            "interval": physical & (F.col("uneven") > 0),
        },
    )


def validate_registry(trajectories):
    """V2: unique ids, one dataset contract, one identity per system, groups whole."""

    def several(keys, distinct, rule):
        group = trajectories.groupBy(*keys).agg(F.count_distinct(distinct).alias("_n"))
        key = F.concat_ws("|", *keys) if keys else F.lit("registry")
        return group.filter(F.col("_n") > 1).select(F.lit(rule).alias("rule"), key.alias("key"))

    repeated = (
        trajectories.groupBy("trajectory_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.lit("duplicate-id").alias("rule"), F.col("trajectory_id").alias("key"))
    )
    dataset = F.struct("dataset_id", "dataset_version", "feature_set_version")
    identity = F.struct("entity_id", "protein_id", "ligand_id")
    return merge(
        repeated,
        several([], dataset, "dataset-contract"),
        several(["system_id"], identity, "system-identity"),
        several(["split_group_id"], F.col("split"), "group-crosses-splits"),
    )


def validate_time_axis(trajectories):
    """V3: what an axis may claim about physical time."""
    frame = F.col("time_unit") == "frame"
    span = (F.col("frame_count") - 1) * F.col("frame_interval_ps") / PS_PER_NS
    largest = F.greatest(F.abs(span), F.abs("duration_ns"))
    uneven = F.abs(span - F.col("duration_ns")) > F.greatest(RTOL * largest, F.lit(ATOL))
    return violations(
        trajectories,
        F.col("trajectory_id"),
        {
            "time-unit": ~F.col("time_unit").isin("frame", "ps", "ns"),
            "frame-axis-claims-time": frame
            & (
                (F.col("sampling_status") != "unavailable")
                | F.col("frame_interval_ps").isNotNull()
                | F.col("duration_ns").isNotNull()
            ),
            "physical-axis-incomplete": ~frame
            & ((F.col("sampling_status") == "unavailable") | F.col("duration_ns").isNull()),
            "assumed-without-note": ~frame
            & (F.col("sampling_status") == "assumed")
            & F.col("sampling_note").isNull(),
            "duration-differs": ~frame & F.coalesce(uneven, F.lit(False)),
        },
    )


def validate_observed(frames, regions, trajectories, features=None):
    """V4: only the fitted intervals are checked, on the declared grid."""
    features = features or feature_columns(frames)
    meta = regions.join(
        trajectories.select("trajectory_id", "frame_count", "frame_interval_ps", "time_unit"),
        "trajectory_id",
        "left",
    )
    bounds = violations(
        meta,
        F.concat_ws("|", "trajectory_id", "start"),
        {
            "region-bounds": (F.col("start") < 0)
            | (F.col("start") >= F.col("stop"))
            | (F.col("stop") > F.col("frame_count"))
        },
    )
    axis = over_blocks(
        trajectories.select("trajectory_id", "frame_count", "frame_interval_ps", "time_unit"),
        F.col("frame_count"),
    )
    before = Window.partitionBy("trajectory_id", "block").orderBy("frame")
    stepped = (
        with_blocks(frames.select("trajectory_id", "frame", "time", *features), before=1)
        .withColumn("_step", F.col("time") - F.lag("time").over(before))
        .filter("own")
        .join(axis, ["trajectory_id", "block"], "left")
        .drop("block", "own")
    )
    factor = F.when(F.col("time_unit") == "ns", PS_PER_NS).otherwise(1.0)
    grid = F.col("frame") * F.col("frame_interval_ps") / factor
    frame_axis = F.col("time_unit") == "frame"
    seen = in_regions(stepped, regions)
    points = violations(
        seen,
        F.concat_ws("|", "trajectory_id", "frame"),
        {
            "finite": _unfit(["time", *features]),
            "time-order": F.coalesce(F.col("_step") <= 0, F.lit(False))
            | ((F.col("frame") == 0) & (F.col("time") != 0)),
            "frame-axis": frame_axis & (F.col("time") != F.col("frame")),
            "interval": ~frame_axis & F.coalesce(_apart(F.col("time"), grid), F.lit(False)),
        },
    )
    return bounds.unionByName(points)


def validate_windows(given, trajectories, assignments, grid):
    """V5: stride, grid, bounds and the identity each window would be made with.

    Decided in closed form from the metadata; no window is generated.
    """
    cells = resolve_grid(trajectories.drop("split").join(
        assignments.select("trajectory_id", "group_id", "split"), "trajectory_id"
    ), grid)
    expected = cells.filter(F.col("reason").isNull()).select(
        "trajectory_id", "context_frames", "horizon_frames", "frame_count",
        F.col("system_id").alias("_system"),
        F.col("group_id").alias("_group"),
        F.col("split").alias("_split"),
        F.col("sampling_status").alias("_status"),
        ((F.col("context_frames") - 1) * F.col("frame_interval_ps")).alias("_c_span"),
        (F.col("horizon_frames") * F.col("frame_interval_ps")).alias("_h_span"),
    )
    rows = given.join(expected, ["trajectory_id", *CELL], "left")
    same = functools.reduce(
        lambda a, b: a & b,
        [
            F.col(mine).eqNullSafe(F.col(theirs))
            for mine, theirs in (
                ("system_id", "_system"), ("group_id", "_group"), ("split", "_split"),
                ("sampling_status", "_status"), ("context_span_ps", "_c_span"),
                ("horizon_span_ps", "_h_span"),
            )
        ],
    )
    known = F.col("frame_count").isNotNull()
    stop = F.col("start") + F.col("context_frames") + F.col("horizon_frames")
    return violations(
        rows,
        F.concat_ws("|", *WINDOW_KEY),
        {
            "unknown-trajectory-or-cell": ~known,
            "stride": (F.col("start") < 0) | (F.col("start") % grid.stride != 0),
            "bounds": known & (stop > F.col("frame_count")),
            "identity": known & ~same,
        },
    )


RANGES = 256


def _marks(rows, keys):
    """Hash range and two independent hashes of a window, as numbers that add up exactly."""
    named = F.concat_ws("|", *keys)  # as text, whatever integer types the sides have
    first, second = F.xxhash64(named), F.xxhash64(F.lit(7), named)
    return rows.withColumns(
        {
            "_range": F.pmod(first, F.lit(RANGES)).cast("int"),
            "_h": first.cast("decimal(20,0)"),
            "_g": second.cast("decimal(20,0)"),
        }
    )


def _differing(predictions, index, keys, per):
    """Cells and hash ranges in which some group's windows are not the declared ones.

    Equal counts and two equal hash sums mean equal multisets; the tables compared here
    have RANGES rows per cell and group.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_h").alias("h"), F.sum("_g").alias("g")]
    where = [*CELL, "_range"]
    want = _marks(index.select(*keys), keys).groupBy(*where).agg(F.struct(*sums).alias("want"))
    held = cut(_marks(predictions.select(*{*keys, *per}), keys).groupBy(*where, *per).agg(F.struct(*sums).alias("has")))
    groups = held.select(*CELL, *per).distinct().groupBy(*CELL).agg(F.count(F.lit(1)).alias("groups"))
    seen = held.groupBy(*where).agg(
        F.min("has").alias("low"), F.max("has").alias("high"), F.count(F.lit(1)).alias("met")
    )
    both = want.join(seen, where, "full_outer").join(groups, [*CELL], "left")
    same = (F.col("low") == F.col("want")) & (F.col("high") == F.col("want")) & (F.col("met") == F.col("groups"))
    return both.filter(~F.coalesce(same, F.lit(False))).select(*where)


def check_coverage(predictions, index, keys=WINDOW_KEY, per=("model", "feature_id", "step")):
    """V6: every declared window scored exactly once; none missing or extra.

    Counts and hash sums per cell and hash range settle the clean case without joining
    windows; only the ranges that differ are joined, to name the rows.
    """
    keys, per = list(keys), list(per)
    named, where = F.concat_ws("|", *keys), [*CELL, "_range"]
    differing = cut(_differing(predictions, index, keys, per))
    inside = lambda rows: _marks(rows, keys).join(differing, where, "left_semi")
    declared = inside(index.select(*keys)).select(*keys)
    mine = inside(predictions.select(*{*keys, *per}))
    scored = mine.select(*keys).distinct()
    missing = declared.join(scored, keys, "left_anti")
    extra = scored.join(declared, keys, "left_anti")
    repeated = mine.groupBy(*keys, *per).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return merge(
        *[
            t.select(F.lit(rule).alias("rule"), named.alias("key"))
            for rule, t in (("missing", missing), ("extra", extra), ("repeated", repeated))
        ]
    )


def check_paired(predictions):
    """V7: all models hold the same labels: one row per model, one target, one origin."""
    label = ["trajectory_id", *CELL, "start", "step", "feature_id"]
    models = predictions.agg(F.count_distinct("model")).scalar()
    rows = predictions.groupBy(*label).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("model").alias("_n"),
        F.min("target").eqNullSafe(F.max("target")).alias("_target"),
        F.min("origin").eqNullSafe(F.max("origin")).alias("_origin"),
        F.min("group_id").eqNullSafe(F.max("group_id")).alias("_group"),
    )
    return violations(
        rows.withColumn("_models", models),
        F.concat_ws("|", *label),
        {
            "unpaired": (F.col("_n") != F.col("_models")) | (F.col("_rows") != F.col("_n")),
            "labels-differ": ~(F.col("_target") & F.col("_origin") & F.col("_group")),
        },
    )


def validate_quantiles(predictions):
    """V8: levels ordered and in (0, 1), lengths match, median equals the point.

    `quantiles_valid`, where present, must agree with the values.
    """
    levels, values = F.col("levels"), F.col("quantiles")
    tag = F.col("quantiles_valid") if "quantiles_valid" in predictions.columns else F.lit(True)
    at = F.array_position(levels, 0.5)
    return violations(
        predictions,
        F.concat_ws("|", "model", "trajectory_id", "start", "step", "feature_id"),
        {
            "level-order": (F.array_sort(levels) != levels)
            | (F.size(F.array_distinct(levels)) != F.size(levels)),
            "level-range": ~F.forall(levels, lambda q: (q > 0) & (q < 1)),
            "length": F.size(levels) != F.size(values),
            "finite": ~F.forall(
                values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
            ),
            "median": (at > 0) & (F.get(values, (at - 1).cast("int")) != F.col("point")),
            "crossing-tag": non_decreasing(values) != tag,
        },
    )


def check_leads(predictions):
    """V9: leads 1..H, one origin and one group per window; target frames aligned."""
    rows = predictions.groupBy("model", *WINDOW_KEY, "feature_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("step").alias("_distinct"),
        F.min("step").alias("_low"),
        F.max("step").alias("_high"),
        F.min("origin").eqNullSafe(F.max("origin")).alias("_origin"),
        F.min("group_id").eqNullSafe(F.max("group_id")).alias("_group"),
        F.count_if(
            F.col("target_frame")
            != F.col("start") + F.col("context_frames") + F.col("step") - 1
        ).alias("_off"),
    )
    h = F.col("horizon_frames")
    whole = (
        (F.col("_n") == h) & (F.col("_distinct") == h) & (F.col("_low") == 1) & (F.col("_high") == h)
    )
    return violations(
        rows,
        F.concat_ws("|", "model", *WINDOW_KEY, "feature_id"),
        {
            "leads": ~whole,
            "origin": ~F.col("_origin"),
            "group": ~F.col("_group"),
            "target-frame": F.col("_off") > 0,
        },
    )


def cell_counts(predictions):
    """Groups, systems, trajectories and windows per model and cell.

    Windows are reduced to one row each before the distinct counts.
    """
    windows = predictions.groupBy("model", *WINDOW_KEY, "system_id", "group_id").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    out = windows.groupBy("model", *CELL).agg(
        F.count_distinct("group_id").alias("groups"),
        F.count_distinct("system_id").alias("systems"),
        F.count_distinct("trajectory_id").alias("trajectories"),
        F.count(F.lit(1)).alias("windows"),
        F.sum("_rows").alias("rows"),
    )
    ordered = (F.col("groups") <= F.col("systems")) & (F.col("systems") <= F.col("trajectories"))
    return out.withColumn("ordered", ordered & (F.col("trajectories") <= F.col("windows")))


def check_transfer(source_features, target_features, source_entities, target_entities):
    """Fitted and target channels identical, entity ids disjoint."""
    columns = ["feature_id", "ordinal", "unit", "definition", "feature_set_version"]
    a, b = source_features.select(*columns), target_features.select(*columns)
    shared = source_entities.select("entity_id").intersect(target_entities.select("entity_id"))
    return merge(
        *[
            t.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
            for rule, t, key in (
                ("fitted-only", a.exceptAll(b), "feature_id"),
                ("target-only", b.exceptAll(a), "feature_id"),
                ("shared-entity", shared.filter(F.col("entity_id").isNotNull()), "entity_id"),
            )
        ]
    )


def validate_scaler(scaler, fitted, declared):
    """Fitted regions equal the TRAIN regions, disjoint, and sum to the count."""
    columns = ["trajectory_id", "start", "stop"]
    a, b = fitted.select(*columns), declared.select(*columns)
    named = F.concat_ws("|", *columns)
    overlap = reached_before(a).filter(F.col("reached") > F.col("start"))
    covered = a.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).scalar()
    count = scaler.filter(F.col("sample_count") != covered)
    return merge(
        a.exceptAll(b).select(F.lit("undeclared-region").alias("rule"), named.alias("key")),
        b.exceptAll(a).select(F.lit("missing-region").alias("rule"), named.alias("key")),
        overlap.select(F.lit("overlap").alias("rule"), named.alias("key")),
        count.select(F.lit("sample-count").alias("rule"), F.col("feature_id").alias("key")),
    )


def validate_cohort(roles, official, excluded, counts, available=None):
    """Disjoint roles, nothing excluded, declared counts, official agreement."""
    wanted = F.create_map(*[F.lit(x) for k, v in ROLE_SPLITS.items() for x in (k, v)])
    repeated = roles.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    banned = roles.join(excluded.select("id").distinct(), "id", "left_semi")
    judged = roles.select("id", "role").join(
        official.select("id", F.col("split").alias("_official")), "id", "left"
    )
    wrong = judged.filter(~F.col("_official").eqNullSafe(wanted[F.col("role")]))
    declared = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, v)])
    sized = roles.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    off = sized.filter(~F.col("_n").eqNullSafe(declared[F.col("role")].cast("long")))
    tables = [
        repeated.select(F.lit("role-overlap").alias("rule"), F.col("id").cast("string").alias("key")),
        banned.select(F.lit("excluded").alias("rule"), F.col("id").cast("string").alias("key")),
        wrong.select(F.lit("official-split").alias("rule"), F.col("id").cast("string").alias("key")),
        off.select(F.lit("role-count").alias("rule"), F.col("role").alias("key")),
    ]
    if available is not None:
        absent = roles.join(available.select("id").distinct(), "id", "left_anti")
        tables.append(
            absent.select(F.lit("not-eligible").alias("rule"), F.col("id").cast("string").alias("key"))
        )
    return merge(*tables)
