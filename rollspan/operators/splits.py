"""Leak-free partitions over dependency groups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions.checked import required
from rollspan.functions.hashing import hash_rank
from rollspan.session import cut
from rollspan.tables import SPLITS

RATIO_TOLERANCE = 1e-12


def refuse(bad, message):
    """Stop when a check finds a row."""
    row = bad.first()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def resolve_labels(trajectories, field=None, mapping=None):
    """One label per trajectory, from a column or a complete explicit mapping."""
    if (field is None) == (mapping is None):
        raise ValueError("give either a column or a mapping")
    if field is not None:
        labels = trajectories.select("trajectory_id", F.col(field).alias("label"))
    else:
        labels = trajectories.select("trajectory_id", F.lit(True).alias("_known")).join(
            mapping.select("trajectory_id", "label"), "trajectory_id", "full_outer"
        )
        refuse(labels.filter(F.col("_known").isNull()), "label for an unknown trajectory")
        labels = labels.drop("_known")
    clean = F.coalesce((F.col("label") != "") & (F.trim("label") == F.col("label")), F.lit(False))
    refuse(labels.filter(~clean), "missing or padded label")
    return labels


def components(trajectories, labels):
    """Transitive union of equal system, source group and label.

    Each relation becomes a star around its smallest member; alternating large-star
    and small-star rounds (Kiveris et al., 2014) shrink every component to one star
    in a logarithmic number of rounds. Each round is one min aggregate, combined
    before the shuffle, and one equi join of two written tables, so that Spark can
    split the rows of a relation or node that many members share. A trajectory without
    a label is refused.
    """
    label = required(F.col("label"), "a trajectory has no label")
    named = trajectories.join(labels, "trajectory_id", "left").withColumn("label", label)
    members = named.select(
        F.col("trajectory_id").alias("u"),
        F.explode(
            F.array(
                F.struct(F.lit("system").alias("k"), F.col("system_id").alias("r")),
                F.struct(F.lit("source").alias("k"), F.col("split_group_id").alias("r")),
                F.struct(F.lit("label").alias("k"), F.col("label").alias("r")),
            )
        ).alias("rel"),
    ).select("u", "rel.k", "rel.r")
    centres = cut(members.groupBy("k", "r").agg(F.min("u").alias("v")))
    edges = members.join(centres, ["k", "r"]).filter(F.col("u") > F.col("v"))
    edges = cut(edges.select("u", "v").distinct())
    mark = _mark(edges)
    while True:
        edges = cut(_small_star(_large_star(edges)))
        following = _mark(edges)
        if following == mark:
            break
        mark = following
    return (
        trajectories.select("trajectory_id")
        .join(edges.select(F.col("u").alias("trajectory_id"), F.col("v").alias("root")),
              "trajectory_id", "left")
        .select("trajectory_id", F.coalesce("root", "trajectory_id").alias("group_id"))
    )


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges):
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _mark(edges):
    """Order-free mark of an edge set; two scalars."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def official_split(trajectories, groups):
    """Keep given labels; missing labels or a component over two splits fail."""
    rows = trajectories.select("trajectory_id", "split").join(groups, "trajectory_id")
    spread = rows.groupBy("group_id").agg(
        F.min("split").alias("low"),
        F.max("split").alias("high"),
        F.count_if(F.col("split").isNull()).alias("missing"),
    )
    bad = spread.filter((F.col("missing") > 0) | (F.col("low") != F.col("high")))
    refuse(bad, "official labels are missing or cross a dependency group")
    return rows.select("trajectory_id", "group_id", "split")


def split_quotas(spark, ratios):
    """The declared share of each split, in their fixed order."""
    if len(ratios) != len(SPLITS) or min(ratios) < 0 or max(ratios) > 1:
        raise ValueError("give one share between 0 and 1 for each split")
    if abs(1 - sum(ratios)) > RATIO_TOLERANCE:
        raise ValueError("the shares of the splits do not add up to 1")
    return spark.createDataFrame(
        [(i, s, float(r)) for i, (s, r) in enumerate(zip(SPLITS, ratios))],
        "place int, split string, ratio double",
    )


def apportion(quotas, groups):
    """Groups per split (`n`) and those of the splits before it (`first`).

    Every split gets the whole part of its exact share; one more goes to the splits
    with the largest fractions, the earlier split first among equals. `groups` is a
    table of one number. A split with a share but no group stops the job.
    """
    share = F.col("groups") * F.col("ratio")
    every, order = Window.partitionBy(), Window.orderBy(F.desc(share - F.floor(share)), "place")
    left = F.col("groups") - F.sum(F.floor(share)).over(every)
    n = F.floor(share) + (F.row_number().over(order) <= left).cast("long")
    rows = quotas.withColumn("groups", groups.scalar()).withColumn("n", n)
    stop = F.raise_error(F.lit("a split would get no dependency group"))
    rows = rows.withColumn("n", F.when((F.col("n") > 0) | (F.col("ratio") == 0), F.col("n")).otherwise(stop))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("split", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def grouped_split(groups, ratios, seed):
    """C4: whole components in SHA-256 order, cut at the largest-remainder counts."""
    keys = groups.select("group_id").distinct()
    quotas = split_quotas(groups.sparkSession, ratios)
    parts = apportion(quotas, keys.agg(F.count(F.lit(1)).alias("groups"))).collect()  # three rows
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "group_id"), 256)
    ranked = hash_rank(keys, digest, ["group_id"], "_rank")
    split = F.lit(None).cast("string")
    for part in parts:
        inside = F.col("_rank").between(part["first"], part["first"] + part["n"] - 1)
        split = F.when(inside, part["split"]).otherwise(split)
    placed = ranked.select("group_id", split.alias("split"))
    return groups.join(placed, "group_id").select("trajectory_id", "group_id", "split")


def replica_split(trajectories, groups, partitions):
    """Named replicas to TRAIN or TEST; the component stays the unit.

    Every component must be one system holding exactly the named replicas once.
    """
    if set(partitions.values()) != {"train", "test"}:
        raise ValueError("name both TRAIN and TEST replicas")
    rows = trajectories.select("trajectory_id", "system_id", "replicate_id", "split").join(
        groups, "trajectory_id"
    )
    named = F.col("replicate_id").isin(*partitions)
    held = rows.groupBy("group_id").agg(
        F.min("system_id").alias("low"),
        F.max("system_id").alias("high"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(named).alias("named"),
        F.count_distinct("replicate_id").alias("distinct"),
        F.count("split").alias("official"),
    )
    bad = held.filter(
        (F.col("low") != F.col("high"))
        | (F.col("rows") != len(partitions))
        | (F.col("named") != len(partitions))
        | (F.col("distinct") != len(partitions))
        | (F.col("official") > 0)
    )
    refuse(bad, "a component differs from the named replicas")
    lookup = F.create_map(*[F.lit(x) for pair in sorted(partitions.items()) for x in pair])
    return rows.select("trajectory_id", "group_id", lookup[F.col("replicate_id")].alias("split"))


def select_development(assignments, n, seed):
    """At most n whole TRAIN groups by SHA-256 rank, and their trajectories."""
    train = assignments.filter(F.col("split") == "train")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "group_id"), 256)
    chosen = (
        train.select("group_id").distinct().orderBy(digest, "group_id").limit(n)
    )
    return train.join(chosen, "group_id", "left_semi").select("trajectory_id", "group_id", "split")
