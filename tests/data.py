"""Hand-made canonical tables."""

from rollspan.tables import TRAJECTORIES, conform

SPLITS = ["train", "train", "train", "validation", "validation", "test"]


def trajectories(spark, n=6, frames=6, splits=SPLITS, **extra):
    rows = [
        dict(
            trajectory_id=f"trajectory-{i}", dataset_id="d", dataset_version="1",
            feature_set_version="1", system_id=f"system-{i}", split_group_id=f"group-{i}",
            replicate_id="1", split=splits[i], frame_count=frames, time_unit="frame",
            sampling_status="unavailable", **extra,
        )
        for i in range(n)
    ]
    names = list(rows[0])
    types = {"frame_count": "int", "frame_interval_ps": "double", "duration_ns": "double"}
    ddl = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)
    return conform(spark.createDataFrame([tuple(r.values()) for r in rows], ddl), TRAJECTORIES)


def assignments(table):
    from pyspark.sql import functions as F

    return table.select("trajectory_id", F.col("split_group_id").alias("group_id"), "split")


def frames(spark, position, n=6, length=6):
    rows = [
        (f"trajectory-{i}", t, float(t), float(position(i, t)), 7.0)
        for i in range(n)
        for t in range(length)
    ]
    return spark.createDataFrame(
        rows, "trajectory_id string, frame long, time double, position double, constant double"
    )


def arrays(spark, *series):
    """Window rows from (context, target) pairs."""
    rows = [
        (f"t{i}", 0, len(c), len(t), f"s{i}", f"g{i}", "train", "x", [float(v) for v in c],
         [float(v) for v in t])
        for i, (c, t) in enumerate(series)
    ]
    return spark.createDataFrame(
        rows,
        "trajectory_id string, start long, context_frames int, horizon_frames int, "
        "system_id string, group_id string, split string, feature_id string, "
        "context array<double>, target array<double>",
    )
