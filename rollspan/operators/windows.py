"""Rolling-origin windows over ordered frames."""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions import blocks as blk
from rollspan.functions.arrays import roll
from rollspan.functions.blocks import block_of, over_blocks, with_blocks
from rollspan.functions.hashing import fingerprint_frame
from rollspan.tables import WINDOW_KEY

# Tolerances of the alignment check and picoseconds per nanosecond.
RTOL = 1e-9
ATOL = 1e-10
PS_PER_NS = 1000.0


@dataclass(frozen=True)
class Grid:
    """Context and horizon lengths, in frames or in physical time."""

    contexts: tuple
    horizons: tuple
    stride: int
    unit: str = "frame"
    allow_assumed: bool = False

    def __post_init__(self):
        for lengths in (self.contexts, self.horizons):
            if not lengths or len(set(lengths)) != len(lengths):
                raise ValueError("grid lengths must be present and unique")
        if self.stride < 1 or min(self.horizons) <= 0 or min(self.contexts) < 0:
            raise ValueError("stride and lengths must be positive")
        if self.unit == "frame":
            if any(v != int(v) for v in (*self.contexts, *self.horizons)):
                raise ValueError("frame lengths must be integers")
            if min(self.contexts) < 1:
                raise ValueError("a context needs at least one frame")

    @property
    def span(self):
        """Longest context plus horizon, in frames."""
        if self.unit != "frame":
            raise ValueError("the frame span of a physical grid depends on sampling")
        return int(max(self.contexts) + max(self.horizons))


def _cells(grid):
    """The grid as one constant array, exploded next to each trajectory."""
    pairs = [
        F.struct(F.lit(float(c)).alias("context"), F.lit(float(h)).alias("horizon"))
        for c in sorted(grid.contexts)
        for h in sorted(grid.horizons)
    ]
    return F.explode(F.array(*pairs))


def resolve_grid(trajectories, grid):
    """Every grid cell in frames, per trajectory, with a reason where it fails.

    A physical context is a first-to-last span, so it has one frame more than steps.
    """
    rows = trajectories.withColumn("_cell", _cells(grid)).select(
        *trajectories.columns, "_cell.context", "_cell.horizon"
    )
    if grid.unit == "frame":
        rows = rows.withColumn("context_frames", F.col("context").cast("int"))
        rows = rows.withColumn("horizon_frames", F.col("horizon").cast("int"))
        trouble = F.lit(None).cast("string")
    else:
        factor = PS_PER_NS if grid.unit == "ns" else 1.0
        interval = F.col("frame_interval_ps")
        ratio = {n: F.col(n) * F.lit(factor) / interval for n in ("context", "horizon")}
        steps = {n: F.rint(r) for n, r in ratio.items()}

        def misaligned(n):
            gap = F.abs(ratio[n] - steps[n])
            largest = F.greatest(F.abs(ratio[n]), F.abs(steps[n]))
            return gap > F.greatest(F.lit(RTOL) * largest, F.lit(ATOL))

        rows = rows.withColumn("context_frames", (steps["context"] + 1).cast("int"))
        rows = rows.withColumn("horizon_frames", steps["horizon"].cast("int"))
        unverified = (F.col("sampling_status") != "verified") & F.lit(not grid.allow_assumed)
        trouble = (
            F.when(interval.isNull(), "no uniform interval")
            .when(unverified, "time is not verified")
            .when(misaligned("context") | misaligned("horizon"), "not aligned to the interval")
        )
    length = F.col("context_frames") + F.col("horizon_frames")
    return rows.withColumn(
        "reason",
        F.coalesce(
            trouble,
            F.when(
                (F.col("horizon_frames") < 1) | (length > F.col("frame_count")),
                "longer than the series",
            ),
        ),
    )


def feasibility(trajectories, grid):
    """Closed-form window count per trajectory and cell, zero with a reason."""
    cells = resolve_grid(trajectories, grid)
    spare = F.col("frame_count") - F.col("context_frames") - F.col("horizon_frames")
    fits = F.col("reason").isNull()
    return cells.select(
        "trajectory_id",
        "context",
        "horizon",
        F.when(fits, F.col("context_frames")).alias("context_frames"),
        F.when(fits, F.col("horizon_frames")).alias("horizon_frames"),
        F.when(fits, F.floor(spare / grid.stride) + 1)
        .otherwise(0)
        .cast("long")
        .alias("window_count"),
        "reason",
    )


def require_feasible(trajectories, grid):
    """Refuse the whole request when any selected trajectory cannot hold a cell."""
    bad = feasibility(trajectories, grid).filter(F.col("reason").isNotNull()).first()
    if bad is not None:
        raise ValueError(f"impossible cell for {bad['trajectory_id']}: {bad['reason']}")


def admit(trajectories, assignments, grid, split=None):
    """The grid cells that fit, and beside them the rejected ones with their reason."""
    cells = resolve_grid(_selected(trajectories, assignments, split), grid)
    rejected = cells.filter(F.col("reason").isNotNull()).select(
        "trajectory_id", "context", "horizon", "reason"
    )
    return cells.filter(F.col("reason").isNull()), rejected


def _selected(trajectories, assignments, split):
    kept = assignments.select("trajectory_id", "group_id", "split")
    if split is not None:
        kept = kept.filter(F.col("split") == split)
    return trajectories.drop("split").join(kept, "trajectory_id")


def windows(trajectories, assignments, grid, split=None):
    """Window indices; one cell that does not fit refuses the whole request."""
    require_feasible(_selected(trajectories, assignments, split), grid)
    cells, _ = admit(trajectories, assignments, grid, split)
    return cell_windows(cells, grid.stride)


def cell_windows(cells, stride):
    """Window indices of admitted cells, in blocks of start frames.

    Starts are produced per (trajectory, block), after a small shuffle of the block
    list, so a very long trajectory is not enumerated in one task. `block` stays on
    the rows: `window_arrays` joins on it without shuffling them again.
    """
    last = (F.col("frame_count") - F.col("context_frames") - F.col("horizon_frames")).cast("long")
    blocks = (
        over_blocks(cells.withColumn("_last", last), F.col("_last") + 1)
        .select(
            "trajectory_id", "block", "_last", "system_id", "group_id", "split",
            "sampling_status", "context_frames", "horizon_frames", "frame_interval_ps",
        )
        .repartition("trajectory_id", "block")
    )
    stride = F.lit(stride).cast("long")
    low = F.ceil(F.col("block") * blk.BLOCK / stride) * stride
    high = F.least(F.col("_last"), (F.col("block") + 1) * blk.BLOCK - 1)
    starts = F.when(low <= high, F.sequence(low, high, stride)).otherwise(
        F.array().cast("array<bigint>")
    )
    interval = F.col("frame_interval_ps")
    return blocks.withColumn("start", F.explode(starts)).select(
        *WINDOW_KEY,
        "system_id",
        "group_id",
        "split",
        "sampling_status",
        ((F.col("context_frames") - 1) * interval).alias("context_span_ps"),
        (F.col("horizon_frames") * interval).alias("horizon_span_ps"),
        "block",
    )


def _earlier(keys, order):
    return (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def reached_before(spans):
    """Add `reached`: the largest stop of all intervals that start earlier.

    Found inside blocks of starts; what earlier blocks reach is carried in from one
    summary row per block, so no task orders all intervals of a trajectory.
    """
    rows = spans.withColumn("block", block_of(F.col("start")))
    key = ["trajectory_id", "block"]
    carried = (
        rows.groupBy(*key)
        .agg(F.max("stop").alias("_stop"))
        .select(*key, F.max("_stop").over(_earlier(key[:1], ["block"])).alias("_carried"))
    )
    inside = F.max("stop").over(_earlier(key, ["start", "stop"]))
    return (
        rows.join(carried, key)
        .withColumn("reached", F.greatest(inside, F.col("_carried")))
        .drop("_carried")
    )


def context_regions(index):
    """Union of overlapping or touching context intervals per trajectory.

    Equal intervals of different cells are reduced first. An interval opens an
    island when it starts after everything before it has stopped; islands are
    numbered per block and shifted by the count of earlier blocks.
    """
    spans = index.select(
        "trajectory_id", "start", (F.col("start") + F.col("context_frames")).alias("stop")
    ).distinct()
    flagged = reached_before(spans).withColumn(
        "_new", F.coalesce(F.col("start") > F.col("reached"), F.lit(True)).cast("long")
    )
    key = ["trajectory_id", "block"]
    numbers = (
        flagged.groupBy(*key)
        .agg(F.sum("_new").alias("_c"))
        .select(
            *key,
            F.coalesce(F.sum("_c").over(_earlier(key[:1], ["block"])), F.lit(0)).alias("_before"),
        )
    )
    upto = Window.partitionBy(*key).orderBy("start", "stop")
    return (
        flagged.withColumn("_row", F.sum("_new").over(upto))
        .join(numbers, key)
        .withColumn("_island", F.col("_before") + F.col("_row"))
        .groupBy("trajectory_id", "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_island")
    )


def packed_frames(frames, features, span):
    """One row per (trajectory, block): ordered value arrays reaching `span` ahead."""
    rows = with_blocks(frames.select("trajectory_id", "frame", *features), after=span - 1)
    packed = rows.groupBy("trajectory_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("frame", *features))).alias("_rows")
    )
    return packed.select(
        "trajectory_id",
        "block",
        *[F.col("_rows").getField(f).alias(f"_v_{f}") for f in features],
    )


def window_channels(frames, index, features, span, with_targets=True):
    """W5, one row per window: `channels` holds each feature's context and target."""
    packed = packed_frames(frames, features, span)
    if "block" not in index.columns:
        index = index.withColumn("block", block_of(F.col("start")))
    at = (F.col("start") - F.col("block") * blk.BLOCK + 1).cast("int")
    c, h = F.col("context_frames"), F.col("horizon_frames")
    channels = []
    for name in features:
        values = F.col(f"_v_{name}")
        parts = [F.lit(name).alias("feature_id"), F.slice(values, at, c).alias("context")]
        if with_targets:
            parts.append(F.slice(values, at + c, h).alias("target"))
        channels.append(F.struct(*parts))
    keep = [name for name in index.columns if name != "block"]
    return index.join(packed, ["trajectory_id", "block"]).select(
        *keep, F.array(*channels).alias("channels")
    )


def by_feature(channels):
    """One row per window and feature."""
    keep = [name for name in channels.columns if name != "channels"]
    return channels.select(*keep, F.inline("channels"))


def window_arrays(frames, index, features, span, with_targets=True):
    """Context and target arrays per window and feature.

    Frames are shuffled once by (trajectory, block), each block with a halo of
    `span` frames; a window reads its slices from exactly one block.
    """
    return by_feature(window_channels(frames, index, features, span, with_targets))


def first_windows(cells):
    """The first legal window of each trajectory, of its smallest fitting cell.

    `cells` are grid cells with their reason (W1). A cell that fits holds a window at
    start 0, so no window is made to find it.
    """
    names = [c for c in cells.columns if c not in ("trajectory_id", "reason")]
    first = F.min_by(F.struct(*names), F.struct("context_frames", "horizon_frames"))
    return (
        cells.filter(F.col("reason").isNull())
        .groupBy("trajectory_id")
        .agg(first.alias("_w"))
        .select("trajectory_id", F.lit(0).cast("long").alias("start"), "_w.*")
    )


def export_training(arrays):
    """TRAIN and VALIDATION rows with their whole series, context then target."""
    kept = arrays.filter(F.col("split").isin("train", "validation"))
    return kept.select(
        "split",
        *WINDOW_KEY,
        "system_id",
        "group_id",
        "feature_id",
        F.concat("context", "target").alias("series"),
    )


def training_inventory(exported):
    """Counts and the content fingerprint of an export."""
    counts = exported.groupBy("split").agg(
        F.count_distinct("trajectory_id", "start", "context_frames", "horizon_frames").alias(
            "windows"
        ),
        F.count_distinct("trajectory_id").alias("trajectories"),
        F.count(F.lit(1)).alias("rows"),
    )
    marks = None
    for name in ("train", "validation"):
        mark = fingerprint_frame(exported.filter(F.col("split") == name)).select(
            F.lit(name).alias("split"), "fingerprint"
        )
        marks = mark if marks is None else marks.unionByName(mark)
    return counts.join(marks, "split")


def input_condition(arrays, target, condition, k=0):
    """Target-only, joint, or auxiliary contexts rolled by k inside the window."""
    if condition == "joint":
        return arrays
    if condition == "target-only":
        return arrays.filter(F.col("feature_id") == target)
    if condition != "shifted" or k < 1:
        raise ValueError("unknown condition or trivial shift")
    size = F.size("context")
    shifted = F.when(
        size <= k, F.raise_error(F.lit("the shift must be shorter than the context"))
    ).otherwise(roll(F.col("context"), F.lit(k)))
    return arrays.withColumn(
        "context", F.when(F.col("feature_id") == target, F.col("context")).otherwise(shifted)
    )


def exposure(draws, index):
    """How much of TRAIN a draw log visited (one row)."""
    train = index.filter(F.col("split") == "train")
    key = [*WINDOW_KEY]
    seen = draws.groupBy(*key).agg(F.sum("draws").alias("n")).filter(F.col("n") > 0)
    joined = train.join(seen, key, "left")
    drawn = F.col("n").isNotNull()
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("draws"),
        F.count_if(drawn).alias("windows_seen"),
        F.count(F.lit(1)).alias("windows"),
        F.count_distinct(F.when(drawn, F.col("trajectory_id"))).alias("trajectories_seen"),
        F.count_distinct(F.when(drawn, F.col("system_id"))).alias("systems_seen"),
    )
