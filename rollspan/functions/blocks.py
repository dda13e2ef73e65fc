"""Bounded sub-groups of a trajectory.

One trajectory may hold a large share of all rows, so nothing here works on a whole
trajectory at a time. Frames are cut into blocks of fixed length; rows a block has
to look back or ahead to are copied into it; per-trajectory results are combined
from per-block ones.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

# Frames per block: long enough that halos are a small share of the rows, short
# enough that a block's arrays stay far below a task's memory.
BLOCK = 4096


def block_of(column):
    return F.floor(column / F.lit(BLOCK)).cast("long")


def with_blocks(frames, before=0, after=0):
    """Add `block` and `own`; neighbouring frames are copied in with own = false."""
    frame = F.col("frame")
    if before == 0 and after == 0:
        return frames.withColumn("block", block_of(frame)).withColumn(
            "own", F.lit(True)
        )
    first = F.greatest(F.lit(0).cast("long"), block_of(frame - after))
    last = block_of(frame + before)
    return frames.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "own", F.col("block") == block_of(frame)
    )


def over_blocks(df, count):
    """One copy of each per-trajectory row for every block of `count` frames.

    Joining frames to trajectory-level values on (trajectory_id, block) instead of
    trajectory_id keeps a long trajectory spread over many tasks.
    """
    return df.withColumn(
        "block",
        F.explode(
            F.sequence(F.lit(0).cast("long"), block_of(F.greatest(count, F.lit(1)) - 1))
        ),
    )


def ordered_index(df, keys, bucket, order, name):
    """Zero-based position of each row inside `keys`, in two levels.

    `bucket` must not decrease along `order`. Rows are numbered inside (keys,
    bucket); the rows of earlier buckets are added from their counts.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_offset")
    )
