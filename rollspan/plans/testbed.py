"""The driver's tables as canonical tables.

`events` become one series per user, `lineitem` one monthly series per supplier,
`embeddings` one point cloud per label and `customer` a cohort. Every builder reads
its whole table. As in a real run, series and registries are built once and stored
(in the session's checkpoint folder); every query of the session then reads them.
"""

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions.blocks import ordered_index, with_blocks
from rollspan.operators.moments import context_moments
from rollspan.operators.windows import Grid, admit, cell_windows, window_arrays, window_channels
from rollspan.session import cut, scratch, when_cleared
from rollspan.sources.series import write_scoped
from rollspan.tables import TRAJECTORIES, conform

_STORED = {}


@when_cleared
def _forget(spark):
    """Tables whose files are gone are built again when a query asks for them."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]


def stored(build):
    """Build a canonical table once per application and input folder."""

    @functools.wraps(build)
    def read(spark, sf_dir):
        key = (spark.sparkContext.applicationId, str(sf_dir), build.__name__)
        if key not in _STORED:
            _STORED[key] = cut(build(spark, sf_dir))
        return _STORED[key]

    return read


def stored_as(spark, sf_dir, name, build):
    """A table with parameters, built and written once per application and input folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _STORED:
        _STORED[key] = cut(build())
    return _STORED[key]


EVENT_FEATURES = ["value", "k"]
MONTH_FEATURES = ["quantity", "lines"]
GRID = Grid(contexts=(20,), horizons=(5, 10), stride=5)
MONTH_GRID = Grid(contexts=(40,), horizons=(10,), stride=10)
HOUR = 3_600_000_000
CUTOFF = 0.2
BOX = 0.5


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts):
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


@stored
def event_frames(spark, sf_dir):
    """Frames per user in event order, numbered hour by hour."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("trajectory_id"),
        _micros(F.col("ts").cast("timestamp_ntz")).alias("us"),
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    numbered = ordered_index(
        events, ["trajectory_id"], F.floor(F.col("us") / HOUR), ["us", "event_id"], "frame"
    )
    return numbered.select(
        "trajectory_id",
        "frame",
        F.col("frame").cast("double").alias("time"),
        "value",
        "k",
        "us",
    )


def scoped_store(spark, sf_dir):
    """The event frames written by split and bucket; the path of the store."""
    key = (spark.sparkContext.applicationId, str(sf_dir), "scoped store")
    if key not in _STORED:
        path = scratch(spark)
        write_scoped(event_frames(spark, sf_dir), event_trajectories(spark, sf_dir), path)
        _STORED[key] = path
    return _STORED[key]


@stored
def event_frames_with_gap(spark, sf_dir):
    """Event frames with the seconds since the user's previous event."""
    before = Window.partitionBy("trajectory_id", "block").orderBy("frame")
    gap = (F.col("us") - F.lag("us").over(before)) / F.lit(1e6)
    return (
        with_blocks(event_frames(spark, sf_dir), before=1)
        .withColumn("gap_s", F.coalesce(gap, F.lit(0.0)))
        .filter("own")
        .select("trajectory_id", "frame", "time", "value", "k", "gap_s")
    )


def event_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("frame_count")
    )


@stored
def event_trajectories(spark, sf_dir):
    """One registry row per user; systems are triples, splits go by blocks of nine."""
    u = F.col("user_id")
    nine = F.floor(u / 9)
    split = F.when(nine % 5 <= 2, "train").when(nine % 5 == 3, "validation").otherwise("test")
    rows = event_users(spark, sf_dir).select(
        F.concat(F.lit("u"), u).alias("trajectory_id"),
        F.lit("events").alias("dataset_id"),
        F.lit("1").alias("dataset_version"),
        F.lit("1").alias("feature_set_version"),
        F.concat(F.lit("s"), F.floor(u / 3)).alias("system_id"),
        (u % 3 + 1).cast("string").alias("replicate_id"),
        F.concat(F.lit("g"), F.floor(u / 3)).alias("split_group_id"),
        split.alias("split"),
        "frame_count",
        F.lit("frame").alias("time_unit"),
        F.lit("unavailable").alias("sampling_status"),
    )
    return conform(rows, TRAJECTORIES)


def event_labels(spark, sf_dir):
    """A label that chains the triples of one block of nine users."""
    u = F.col("user_id")
    label = F.when(u % 9 == 8, F.concat(F.lit("s"), u)).otherwise(
        F.floor((u + 1) / 3).cast("string")
    )
    return event_users(spark, sf_dir).select(
        F.concat(F.lit("u"), u).alias("trajectory_id"), label.alias("label")
    )


@stored
def event_assignments(spark, sf_dir):
    """Group = block of nine users, split as registered."""
    u = F.substring("trajectory_id", 2, 20).cast("long")
    return event_trajectories(spark, sf_dir).select(
        "trajectory_id", F.concat(F.lit("c"), F.floor(u / 9)).alias("group_id"), "split"
    )


def event_windows(spark, sf_dir, split=None, grid=GRID):
    """Windows of the cells that fit; `event_rejections` lists the others."""
    cells, _ = admit(
        event_trajectories(spark, sf_dir), event_assignments(spark, sf_dir), grid, split
    )
    return cell_windows(cells, grid.stride)


def event_rejections(spark, sf_dir, grid=GRID):
    return admit(event_trajectories(spark, sf_dir), event_assignments(spark, sf_dir), grid)[1]


def event_arrays(spark, sf_dir, split=None, grid=GRID, features=EVENT_FEATURES):
    return window_arrays(
        event_frames(spark, sf_dir), event_windows(spark, sf_dir, split, grid), features, grid.span
    )


def event_channels(spark, sf_dir, split=None, grid=GRID, features=EVENT_FEATURES):
    return window_channels(
        event_frames(spark, sf_dir), event_windows(spark, sf_dir, split, grid), features, grid.span
    )


def event_moments(spark, sf_dir, split=None, grid=GRID, features=EVENT_FEATURES):
    return context_moments(
        event_frames(spark, sf_dir), event_windows(spark, sf_dir, split, grid), features,
        max(grid.contexts), grid.span,
    )


@stored
def month_frames(spark, sf_dir):
    """Monthly series per supplier; the calendar bounds the months of a supplier."""
    months = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("p"), F.col("l_suppkey")).alias("trajectory_id"),
            F.date_trunc("month", F.col("l_shipdate").cast("timestamp_ntz")).alias("month"),
        )
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.count(F.lit(1)).cast("double").alias("lines"),
        )
    )
    order = Window.partitionBy("trajectory_id").orderBy("month")
    frame = (F.row_number().over(order) - 1).cast("long")
    return months.withColumn("frame", frame).select(
        "trajectory_id",
        "frame",
        F.col("frame").cast("double").alias("time"),
        "quantity",
        "revenue",
        "lines",
    )


@stored
def month_trajectories(spark, sf_dir):
    """One registry row per supplier; suppliers of a nation share a split group."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct(
            F.date_trunc("month", F.col("l_shipdate").cast("timestamp_ntz"))
        ).cast("int").alias("frame_count")
    )
    nation = F.col("s_nationkey") % 5
    split = F.when(nation <= 2, "train").when(nation == 3, "validation").otherwise("test")
    rows = (
        counts.join(
            table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        )
        .select(
            F.concat(F.lit("p"), F.col("l_suppkey")).alias("trajectory_id"),
            F.lit("months").alias("dataset_id"),
            F.lit("1").alias("dataset_version"),
            F.lit("1").alias("feature_set_version"),
            F.concat(F.lit("p"), F.col("l_suppkey")).alias("system_id"),
            F.lit("1").alias("replicate_id"),
            F.concat(F.lit("n"), F.col("s_nationkey")).alias("split_group_id"),
            split.alias("split"),
            "frame_count",
            F.lit("frame").alias("time_unit"),
            F.lit("unavailable").alias("sampling_status"),
        )
    )
    return conform(rows, TRAJECTORIES)


@stored
def month_assignments(spark, sf_dir):
    return month_trajectories(spark, sf_dir).select(
        "trajectory_id", F.col("split_group_id").alias("group_id"), "split"
    )


def month_windows(spark, sf_dir, split=None, grid=MONTH_GRID):
    cells, _ = admit(
        month_trajectories(spark, sf_dir), month_assignments(spark, sf_dir), grid, split
    )
    return cell_windows(cells, grid.stride)


def month_arrays(spark, sf_dir, split=None, grid=MONTH_GRID, features=MONTH_FEATURES):
    return window_arrays(
        month_frames(spark, sf_dir), month_windows(spark, sf_dir, split, grid), features, grid.span
    )


def month_moments(spark, sf_dir, split=None, grid=MONTH_GRID, features=MONTH_FEATURES):
    return context_moments(
        month_frames(spark, sf_dir), month_windows(spark, sf_dir, split, grid), features,
        max(grid.contexts), grid.span,
    )


def month_channels(spark, sf_dir, split=None, grid=MONTH_GRID, features=MONTH_FEATURES):
    return window_channels(
        month_frames(spark, sf_dir), month_windows(spark, sf_dir, split, grid), features, grid.span
    )


@stored
def cloud(spark, sf_dir):
    """One point cloud per label: 22 atoms from the 64 numbers of each vector, the last on the x axis.

    Vectors are numbered inside their label in runs of 4,096 ids.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.col("label")).alias("trajectory_id"), "vec_id", "embedding"
    )
    numbered = ordered_index(
        vectors, ["trajectory_id"], F.floor(F.col("vec_id") / 4096), ["vec_id"], "frame"
    )
    at = [
        F.coalesce(F.get("embedding", F.col("atom") * 3 + i).cast("double"), F.lit(0.0))
        for i in range(3)
    ]
    return (
        numbered.withColumn("atom", F.explode(F.sequence(F.lit(0), F.lit(21))))
        .select(
            "trajectory_id", "frame", F.col("trajectory_id").alias("system_id"), "atom",
            at[0].alias("x"), at[1].alias("y"), at[2].alias("z"),
        )
    )


def cloud_atoms(spark, sf_dir):
    """Static atoms per label: element by position, three atoms to a residue."""
    labels = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.col("label")).alias("system_id")
    ).distinct()
    return labels.withColumn("atom", F.explode(F.sequence(F.lit(0), F.lit(21)))).select(
        "system_id",
        "atom",
        F.when(F.col("atom") % 5 == 4, 1).otherwise(6).alias("atomic_number"),
        F.floor(F.col("atom") / 3).cast("int").alias("residue"),
    )


def cloud_segments(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.col("label")).alias("system_id")
    ).distinct()
    return labels.withColumn("start", F.explode(F.array(F.lit(0), F.lit(14))))


def customers(spark, sf_dir):
    """Cohort inputs: official splits, available ids and excluded ids."""
    rows = table(spark, sf_dir, "customer")
    tail = F.col("c_custkey") % 10
    split = F.when(tail <= 6, "train").when(tail <= 8, "validation").otherwise("test")
    official = rows.select(F.col("c_custkey").alias("id"), split.alias("split"))
    available = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    excluded = rows.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    return official, available, excluded
