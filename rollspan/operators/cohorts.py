"""Deterministic cohorts ranked on identity metadata alone."""

import functools

from pyspark.sql import functions as F

from rollspan.functions.hashing import hash_rank
from rollspan.operators.splits import refuse
from rollspan.tables import ROLE_SPLITS


def _eligible(official, available, excluded):
    return (
        official.select("id", "split")
        .join(available.select("id").distinct(), "id", "left_semi")
        .join(excluded.select("id"), "id", "left_anti")
    )


def eligible_counts(official, available, excluded):
    """Eligible ids per official split."""
    return _eligible(official, available, excluded).groupBy("split").agg(
        F.count(F.lit(1)).alias("eligible")
    )


def select_cohort(official, available, excluded, counts, seed):
    """Ids ranked by SHA-256 inside their split; roles take consecutive ranks.

    Validation and calibration share one pool in that order. A pool with too few ids
    is refused.
    """
    pool = _eligible(official, available, excluded)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "split", "id"), 256)
    ranked = hash_rank(pool, digest, ["id"], "rank", keys=["split"])
    bounds, start = [], {}
    for role, split in ROLE_SPLITS.items():
        low = start.get(split, 0)
        bounds.append((role, split, low, low + counts[role]))
        start[split] = low + counts[role]
    role = F.lit(None).cast("string")
    for name, split, low, high in reversed(bounds):
        inside = (F.col("rank") >= low) & (F.col("rank") < high)
        role = F.when((F.col("split") == split) & inside, name).otherwise(role)
    cohort = ranked.withColumn("role", role).filter(F.col("role").isNotNull()).select(
        "id", "split", "role", "rank"
    )
    require_counts(cohort, counts)
    return cohort


def require_counts(cohort, counts):
    """Refuse a cohort that lacks members for a role."""
    held = cohort.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(n).alias("wanted")) for r, n in counts.items()]
    )
    spark = cohort.sparkSession
    declared = spark.range(1).select(F.inline(wanted))
    short = declared.join(held, "role", "left").filter(
        F.coalesce("n", F.lit(0)) < F.col("wanted")
    )
    refuse(short, "too few eligible ids")


def reserve_roles(candidates, cuts, replica_roles, seed, label="unseen", replicas=10):
    """Ranked ids cut into confirmation, seen-replica and extension slices.

    Confirmation and extension ids keep every replica; a seen id's replicas take
    the role their number is given.
    """
    first, seen, extension = cuts
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(label), "id"), 256)
    ranked = hash_rank(candidates, digest, ["id"], "rank")
    rank = F.col("rank")
    reserved = ranked.withColumn(
        "slice",
        F.when(rank < first, "confirmation")
        .when(rank < first + seen, "seen-replica")
        .when(rank < first + seen + extension, "extension"),
    ).filter(F.col("slice").isNotNull())
    held = candidates.limit(first + seen + extension).count()
    if held < first + seen + extension:
        raise ValueError(f"too few candidates: {held}")
    numbered = reserved.withColumn(
        "replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))
    )
    by_number = {n: role for role, numbers in replica_roles.items() for n in numbers}
    if sorted(by_number) != list(range(1, replicas + 1)):
        raise ValueError("replica roles must partition all replicas")
    lookup = F.create_map(*[F.lit(x) for pair in sorted(by_number.items()) for x in pair])
    return numbered.select(
        "id",
        "rank",
        "slice",
        "replica",
        F.when(F.col("slice") == "seen-replica", lookup[F.col("replica")])
        .otherwise("confirmation")
        .alias("role"),
    )


def overlap_audit(a, b, columns):
    """Which rows of `a` share an exact key with `b`, per array column.

    Keys are hashed; `b` is reduced to distinct hashes first, so a key that many
    rows share never multiplies them.
    """
    flags = []
    for name in columns:
        keys = a.select("id", F.explode(name).alias("_k")).select(
            "id", F.sha2(F.col("_k").cast("string"), 256).alias("_h")
        )
        known = b.select(F.explode(name).alias("_k")).select(
            F.sha2(F.col("_k").cast("string"), 256).alias("_h")
        ).distinct()
        flags.append(
            keys.join(known, "_h", "left_semi")
            .groupBy("id")
            .agg(F.lit(True).alias(f"{name}_shared"))
        )
    joined = functools.reduce(
        lambda left, right: left.join(right, "id", "left"), flags, a.select("id")
    )
    shared = [F.coalesce(f"{c}_shared", F.lit(False)).alias(f"{c}_shared") for c in columns]
    return joined.select("id", *shared)


def overlap_counts(flags):
    """Audited rows and shared rows per column."""
    columns = [c for c in flags.columns if c != "id"]
    return flags.agg(
        F.count(F.lit(1)).alias("audited"), *[F.count_if(c).alias(c) for c in columns]
    )
