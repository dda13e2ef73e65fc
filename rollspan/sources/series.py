"""Canonical series, registries and the operators that bring sources into them."""

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions.blocks import over_blocks, with_blocks
from rollspan.functions.hashing import identity
from rollspan.operators.contracts import validate_frames
from rollspan.operators.splits import refuse
from rollspan.tables import (
    FEATURES,
    PURPOSE_ROLES,
    ROLE_SPLITS,
    SPLITS,
    TRAJECTORIES,
    conform,
    frames_schema,
)

# Fixed value: shape of an official list id.
LIST_ID = "^[0-9][A-Z0-9]{3}$"
# Fixed value: the licence text a catalogue entry must name.
CATALOG_LICENCE = "Creative Commons Attribution 4.0"
CATALOG_REPLICAS = 10


def read_frames(spark, path, features):
    """The `frames` dataset with its declared schema; nothing is inferred.

    `dataset_id` is the partition column, so a filter on it prunes folders.
    """
    return spark.read.schema(frames_schema(features)).parquet(path)


def write_frames(frames, trajectories, path, features):
    """Check the series contract, then publish; an existing output is refused."""
    refuse(validate_frames(frames, trajectories, features), "series contract is broken")
    conform(frames, frames_schema(features)).write.partitionBy("dataset_id").mode(
        "errorifexists"
    ).parquet(path)


def write_registry(trajectories, features, path):
    """S3: publish `trajectories`, ordered by id inside the files, and `features`."""
    conform(trajectories, TRAJECTORIES).repartitionByRange("trajectory_id").sortWithinPartitions(
        "trajectory_id"
    ).write.mode("errorifexists").parquet(f"{path}/trajectories")
    conform(features, FEATURES).write.mode("errorifexists").parquet(f"{path}/features")


def read_registry(spark, path):
    """S3: both registry tables with their fixed schemas."""
    return (
        spark.read.schema(TRAJECTORIES).parquet(f"{path}/trajectories"),
        spark.read.schema(FEATURES).parquet(f"{path}/features"),
    )


def split_lists(lists, pattern=LIST_ID):
    """Id -> split from one table of lines per split; bad or repeated ids fail.

    `lists` maps each split to a DataFrame with a `value` column.
    """
    if set(lists) - set(SPLITS):
        raise ValueError("unknown split name")
    rows = functools.reduce(
        lambda a, b: a.unionByName(b),
        [t.select(F.col("value").alias("id"), F.lit(s).alias("split")) for s, t in lists.items()],
    )
    refuse(rows.filter(~F.col("id").rlike(pattern)), "malformed id in an official list")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    refuse(repeated, "repeated or overlapping id in the official lists")
    return rows


def read_split_lists(spark, paths, pattern=LIST_ID):
    """The three official text lists."""
    return split_lists({s: spark.read.text(p) for s, p in paths.items()}, pattern)


def export_systems(source, registry, requested, splits):
    """Requested ids that are official and present, and why the others are not.

    Returns exported frames, their registry rows with the official split, and issues.
    """
    present = registry.select("system_id").distinct().withColumn("_present", F.lit(True))
    judged = (
        requested.select("system_id")
        .distinct()
        .join(splits.select(F.col("id").alias("system_id"), "split"), "system_id", "left")
        .join(present, "system_id", "left")
    )
    reason = F.when(F.col("split").isNull(), "not in official splits").when(
        F.col("_present").isNull(), "absent from input"
    )
    issues = (
        judged.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(
            "system_id",
            F.when(F.col("split").isNull(), "dropped").otherwise("missing").alias("status"),
            "reason",
        )
    )
    kept = registry.drop("split").join(
        judged.filter(reason.isNull()).select("system_id", "split"), "system_id"
    )
    frames = source.join(kept.select("trajectory_id"), "trajectory_id", "left_semi")
    return frames, kept, issues


def project_channels(source, bindings, keys=("trajectory_id", "frame", "time")):
    """Exactly the bound source channels, under their feature names."""
    absent = [c for c in bindings.values() if c not in source.columns]
    if absent:
        raise ValueError(f"missing source channels {absent}")
    return source.select(
        *keys, *[F.col(c).cast("double").alias(name) for name, c in bindings.items()]
    )


def admit_replicas(frames, sources):
    """Replicas with the declared frame count and constant spacing, time rebased.

    `sources`: trajectory_id, frame_count, frame_interval_ps. Returns admitted
    frames, registry rows (duration from the span) and issues.
    """
    before = Window.partitionBy("trajectory_id", "block").orderBy("frame")
    axis = (
        with_blocks(frames.select("trajectory_id", "frame", "time"), before=1)
        .withColumn("_step", F.col("time") - F.lag("time").over(before))
        .filter("own")
        .groupBy("trajectory_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_step").alias("low"),
            F.max("_step").alias("high"),
            F.min_by("time", "frame").alias("origin"),
            F.max_by("time", "frame").alias("end"),
        )
    )
    judged = sources.join(axis, "trajectory_id", "left")
    even = F.coalesce(
        (F.col("low") == F.col("frame_interval_ps")) & (F.col("high") == F.col("frame_interval_ps")),
        F.col("n") == 1,
    )
    reason = (
        F.when(F.col("n").isNull(), "absent from input")
        .when(F.col("n") != F.col("frame_count"), "frame count differs")
        .when(~even, "spacing differs from the declared interval")
    )
    judged = judged.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull())
    registry = good.select(
        *sources.columns,
        F.lit("ps").alias("time_unit"),
        F.lit("verified").alias("sampling_status"),
        ((F.col("end") - F.col("origin")) / 1000).alias("duration_ns"),
    )
    origins = over_blocks(good.select("trajectory_id", "n", "origin"), F.col("n")).drop("n")
    admitted = (
        with_blocks(frames)
        .join(origins, ["trajectory_id", "block"])
        .withColumn("time", F.col("time") - F.col("origin"))
        .drop("block", "own", "origin")
    )
    issues = judged.filter(F.col("reason").isNotNull()).select(
        "trajectory_id",
        F.when(F.col("n").isNull(), "missing").otherwise("dropped").alias("status"),
        "reason",
        F.lit("admission").alias("phase"),
    )
    return admitted, registry, issues


def drop_failed_groups(registry, issues, key):
    """One failed replica takes its whole group out; the others are logged."""
    failed = registry.join(issues.select("trajectory_id").distinct(), "trajectory_id", "left_semi")
    groups = failed.select(key).distinct()
    kept = registry.join(groups, key, "left_anti")
    dropped = (
        registry.join(groups, key, "left_semi")
        .join(issues.select("trajectory_id").distinct(), "trajectory_id", "left_anti")
        .select(
            "trajectory_id",
            F.lit("dropped").alias("status"),
            F.lit("another replica of the group failed").alias("reason"),
            F.lit("group").alias("phase"),
        )
    )
    return kept, issues.select("trajectory_id", "status", "reason", "phase").unionByName(dropped)


def join_feature_sets(a, b):
    """Two series tables on identity and frame; unmatched or shifted rows fail."""
    keys = ["trajectory_id", "frame"]
    shared = {"trajectory_id", "frame", "time", "dataset_id"}
    joined = a.alias("a").join(b.alias("b"), keys, "full_outer")
    same = F.col("a.time").isNotNull() & (F.col("a.time") == F.col("b.time"))
    time = F.when(same, F.col("a.time")).otherwise(
        F.raise_error(F.lit("feature sets differ in frames or time axis"))
    )
    left = [F.col(f"a.{c}") for c in a.columns if c not in shared]
    right = [F.col(f"b.{c}") for c in b.columns if c not in shared]
    return joined.select(*keys, time.alias("time"), *left, *right)


def common_features(features, others, ids):
    """Definitions of the shared channels; any difference is a violation row."""
    wanted = features.filter(F.col("feature_id").isin(*ids)).alias("a")
    joined = wanted.join(
        others.filter(F.col("feature_id").isin(*ids)).alias("b"), "feature_id", "full_outer"
    )
    differs = ~(
        F.col("a.unit").eqNullSafe(F.col("b.unit"))
        & F.col("a.definition").eqNullSafe(F.col("b.definition"))
    )
    return joined.select(
        "feature_id",
        F.coalesce("a.ordinal", "b.ordinal").alias("ordinal"),
        F.coalesce("a.unit", "b.unit").alias("unit"),
        differs.alias("differs"),
    )


def project_common(frames, features, others, ids):
    """Frames on the shared channels after their definitions are compared."""
    refuse(common_features(features, others, ids).filter("differs"), "definitions differ")
    return frames.select("trajectory_id", "frame", "time", *ids)


CATALOG = (
    "accession string, mdcount int, "
    "metadata struct<PDBIDS: array<string>, LICENSE: string>"
)


def scan_catalog(projects, excluded, schema=CATALOG):
    """Admissible catalogue entries, lowest accession per upper-cased id.

    `projects` has one JSON document per row in `value`; a malformed one stops the job.
    """
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    rows = projects.select(parsed.alias("p")).select("p.*")
    ids = F.col("metadata.PDBIDS")
    return (
        rows.filter(
            (F.size(ids) == 1)
            & (F.col("mdcount") == CATALOG_REPLICAS)
            & F.contains(F.col("metadata.LICENSE"), F.lit(CATALOG_LICENCE))
        )
        .select(F.upper(F.element_at(ids, 1)).alias("id"), "accession")
        .join(excluded.select("id").distinct(), "id", "left_anti")
        .groupBy("id")
        .agg(F.min("accession").alias("accession"))
    )


def read_for_purpose(frames, registry, roles, purpose, official=None):
    """Only series whose role the purpose allows; altered records are refused.

    A record is altered if its split is not the one in `official` (id, split). The
    allowed ids are joined to the scan as a semi join; `read_scoped` prunes the scan.
    """
    allowed = _allowed(roles, purpose)
    if official is not None:
        changed = (
            registry.alias("r")
            .join(allowed.alias("c"), "system_id")
            .join(official.alias("o"), F.col("system_id") == F.col("o.id"), "left")
            .filter(~F.col("r.split").eqNullSafe(F.col("o.split")))
        )
        refuse(changed.select("trajectory_id"), "record changed its official split")
    ids = registry.join(allowed.select("system_id"), "system_id", "left_semi")
    return frames.join(ids.select("trajectory_id"), "trajectory_id", "left_semi")


SCOPE_BUCKETS = 64


def _allowed(roles, purpose):
    if purpose not in PURPOSE_ROLES:
        raise ValueError("unknown purpose")
    return roles.filter(F.col("role").isin(*PURPOSE_ROLES[purpose]))


def _bucket():
    return F.pmod(F.xxhash64("trajectory_id"), F.lit(SCOPE_BUCKETS)).cast("int")


def write_scoped(frames, registry, path):
    """S12 store: frames in folders by the split and a hash bucket of their trajectory.

    A frame without a registry row stops the job. Splits and buckets are few, and a long
    trajectory's frames are written by many tasks.
    """
    known = over_blocks(registry.select("trajectory_id", "split", "frame_count"), F.col("frame_count"))
    rows = with_blocks(frames).join(known.drop("frame_count"), ["trajectory_id", "block"], "left")
    stop = F.raise_error(F.lit("a frame belongs to no registered trajectory"))
    rows = rows.withColumn("split", F.coalesce("split", stop)).withColumn("bucket", _bucket())
    rows.drop("block", "own").write.partitionBy("split", "bucket").mode("errorifexists").parquet(path)


def record_faults(records, frozen, dataset_id, source_checksum, official):
    """Records that may not be read (trajectory_id, reason).

    `records` are the registry rows a process was given, `frozen` the registry rows of
    the frozen cohort. A record that is not among them or differs in any column, that
    names another dataset or other source bytes, or whose split is not the official one
    (id, split) has a fault.
    """
    columns = [c for c in frozen.columns if c != "trajectory_id"]
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"f.`{c}`")) for c in columns if c in records.columns]
    whole = functools.reduce(lambda a, b: a & b, same, F.lit(len(same) == len(columns)))
    rows = (
        records.alias("r")
        .join(frozen.withColumn("_known", F.lit(True)).alias("f"), "trajectory_id", "left")
        .join(official.alias("o"), F.col("r.system_id") == F.col("o.id"), "left")
    )
    reason = (
        F.when(F.col("f._known").isNull(), "unknown record")
        .when(~F.col("r.dataset_id").eqNullSafe(F.lit(dataset_id)), "dataset differs")
        .when(~F.col("r.source_checksum").eqNullSafe(F.lit(source_checksum)), "source differs")
        .when(~F.col("r.split").eqNullSafe(F.col("o.split")), "official split differs")
        .when(~whole, "altered record")
    )
    return rows.select("trajectory_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def read_scoped(spark, path, features, records, roles, purpose, faults):
    """The frames of the records whose role the purpose allows, from a scoped store.

    Records of allowed systems with a fault (trajectory_id, reason) are refused before
    any frame is read. The purpose's splits and the buckets of its trajectories (at most
    SCOPE_BUCKETS numbers) prune the folders; ids are met inside them.
    """
    allowed = _allowed(roles, purpose).select("system_id").distinct()
    mine = records.join(allowed, "system_id", "left_semi").select("trajectory_id", _bucket().alias("bucket"))
    refuse(faults.join(mine, "trajectory_id", "left_semi"), "records are not those of the frozen cohort")
    buckets = sorted(r["bucket"] for r in mine.select("bucket").distinct().collect())
    splits = sorted({ROLE_SPLITS[r] for r in PURPOSE_ROLES[purpose]})
    schema = f"trajectory_id string, frame long, time double, {', '.join(f'{f} double' for f in features)}, split string, bucket int"
    rows = spark.read.schema(schema).parquet(path)
    rows = rows.filter(F.col("split").isin(*splits) & F.col("bucket").isin(*buckets))
    return rows.join(mine, ["bucket", "trajectory_id"], "left_semi").select("trajectory_id", "frame", "time", *features)


def with_ids(df, dataset="dataset_id", source="source_system", trajectory="source_trajectory",
             replicate="replicate_id"):
    """Namespaced system and trajectory keys; blank or padded parts stop the job."""
    stop = F.raise_error(F.lit("identity parts must be nonempty and unpadded"))
    system = F.concat_ws(":", F.col(dataset), F.lit("system"), identity(F.col(source)))
    system = F.when(identity(F.col(source)).isNotNull(), system).otherwise(stop)
    keyed = df.withColumn("system_id", system)
    parts = identity(F.col("system_id"), F.col(trajectory), F.col(replicate))
    return keyed.withColumn(
        "trajectory_id",
        F.when(parts.isNotNull(), F.concat(F.lit("trajectory:"), parts)).otherwise(stop),
    )
