"""Group-level bootstrap intervals and paired comparisons."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspan.functions.checked import bounded
from rollspan.functions.hashing import hash_rank
from rollspan.session import cut
from rollspan.tables import CELL


HELD_SUMS = 4_000_000  # weighted sums that a task holds before it hands them on


@dataclass(frozen=True)
class Policy:
    """Interval policy, frozen before scoring."""

    seed: int
    samples: int
    confidence: float = 0.95
    min_groups: int = 5
    min_tail: int = 10
    family: int = 1

    def tail(self, corrected):
        return (1 - self.confidence) / (2 * (self.family if corrected else 1))


def interval_status(groups, policy, corrected=False):
    """Why an interval is or is not reported."""
    resolved = policy.samples * policy.tail(corrected) >= policy.min_tail
    return F.when(groups < policy.min_groups, "insufficient-groups").otherwise(
        "descriptive-bootstrap" if resolved else "insufficient-bootstrap-resolution"
    )


def group_index(values, population):
    """Zero-based index of each group of a population, in hashed order, and the count.

    The order only has to be fixed; hashing it keeps the numbering out of one task.
    The counts have one row per population (a declared cell or feature).
    """
    groups = values.select(*population, "group_id").distinct()
    counts = groups.groupBy(*population).agg(F.count(F.lit(1)).alias("groups"))
    ranked = hash_rank(groups, F.md5("group_id"), ["group_id"], "idx", keys=population)
    return ranked.join(bounded(counts), list(population))


def draws(index, population, policy):
    """`samples` resamples of n groups: draw j of sample b is a hash modulo n.

    Each group row stands for one draw position, so the table is produced where the
    groups are and never as one long array. All series share the draws.
    """
    number = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit(str(policy.seed)), "b", "idx")), 1, 8), 16, 10
    ).cast("long")
    return index.select(
        *population,
        "idx",
        "groups",
        F.explode(F.sequence(F.lit(0), F.lit(policy.samples - 1))).alias("b"),
    ).select(*population, "b", (number % F.col("groups")).alias("idx"))


def _weighted_sums(samples):
    """Per key of a task: the sum of values under each sample's multiplicities.

    Behind the `samples` weighted sums stand the plain sum, the count and the number of
    values that are no numbers. Vectors leave the task when many keys are held.
    """

    def run(batches):
        places, groups, sums = {}, [], np.zeros((0, samples + 3))

        def out():
            return pa.RecordBatch.from_pydict(
                {"key": list(places), "groups": groups, "sums": list(sums[: len(places)])}
            )

        for batch in batches:
            lists = batch.column("members")
            bounds = np.asarray(lists.offsets).tolist()
            keys, values = (lists.values.field(i) for i in (0, 1))
            values = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
            numbered = keys.dictionary_encode()
            names, code = numbered.dictionary.to_pylist(), np.asarray(numbered.indices)
            drawn = batch.column("drawn")
            ends = np.asarray(drawn.offsets).tolist()
            sample, held = np.asarray(drawn.values), batch.column("groups").to_pylist()
            for row, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                own = code[lo:hi]
                for name in {names[c] for c in own.tolist()}.difference(places):
                    places[name] = len(places)
                    groups.append(held[row])
                if len(places) > len(sums):
                    sums = np.pad(sums, ((0, 2 * len(places) - len(sums)), (0, 0)))
                at = np.array([places[names[c]] for c in own.tolist()])
                v = values[lo:hi]
                weights = np.ones(samples + 3)
                weights[:samples] = np.bincount(sample[ends[row] : ends[row + 1]], minlength=samples)
                weights[samples + 2] = 0
                rows = np.where(np.isnan(v), 0, v)[:, None] * weights
                rows[:, samples + 1], rows[:, samples + 2] = 1, ~np.isfinite(v)
                np.add.at(sums, at, rows)
            if len(places) * samples > HELD_SUMS:
                yield out()
                places, groups, sums = {}, [], np.zeros((0, samples + 3))
        if places:
            yield out()

    return run


def _resampled(samples, tails):
    """One series: its vectors added up, the mean and the tails of the resampled means."""

    def run(table):
        sums = np.stack([np.asarray(v) for v in table.column("sums").to_pylist()]).sum(axis=0)
        groups = table.column("groups")[0].as_py()
        return pa.table(
            {
                "key": table.column("key").slice(0, 1),
                "groups": pa.array([groups], pa.int64()),
                "held": pa.array([int(sums[samples + 1])], pa.int64()),
                "bad": pa.array([int(sums[samples + 2])], pa.int64()),
                "mean": pa.array([sums[samples] / groups]),
                "q": pa.array([np.quantile(sums[:samples] / groups, tails)], pa.list_(pa.float64())),
            }
        )

    return run


def bootstrap_ci(values, series, policy, population=CELL):
    """Percentile bounds of resampled group means, one row per series.

    `values` has one finite `value` per series and group; every series of a population
    must cover the same groups. A sample is a vector of multiplicities: each group gets
    the list of samples that drew it, once for all series, and a task adds multiplicity
    times value for all samples at once. What is shuffled of that are `samples` numbers
    per series and task. Marginal and corrected tails come from the same means.
    """
    population, series = list(population), list(series)
    key = F.to_json(F.struct(*population, *series), {"ignoreNullFields": "false"})
    members = cut(
        values.select(*population, "group_id", F.struct(key.alias("key"), F.col("value").cast("double").alias("value")).alias("m"))
        .groupBy(*population, "group_id")
        .agg(F.collect_list("m").alias("members"))
    )
    index = cut(group_index(members.select(*population, "group_id"), population))
    drawn = draws(index, population, policy).groupBy(*population, "idx").agg(F.collect_list("b").alias("drawn"))
    rows = (
        index.join(members, [*population, "group_id"])
        .join(drawn, [*population, "idx"], "left")
        .select("groups", "members", F.coalesce("drawn", F.array().cast("array<int>")).alias("drawn"))
    )
    sums = rows.mapInArrow(_weighted_sums(policy.samples), "key string, groups long, sums array<double>")
    tails = [t for c in (False, True) for t in (policy.tail(c), 1 - policy.tail(c))]
    found = sums.groupBy("key").applyInArrow(
        _resampled(policy.samples, tails),
        "key string, groups long, held long, bad long, mean double, q array<double>",
    )
    whole = (F.col("held") == F.col("groups")) & (F.col("bad") == 0)
    mean = F.when(whole, F.col("mean")).otherwise(
        F.raise_error(F.lit("a series needs one finite value for each group"))
    )
    names = T.StructType([values.schema[c] for c in (*population, *series)])
    out = [F.col(f"_key.{c}").alias(c) for c in (*population, *series)] + [mean.alias("mean"), "groups"]
    for i, label in enumerate(("marginal", "corrected")):
        status = interval_status(F.col("groups"), policy, corrected=bool(i))
        ok = status == "descriptive-bootstrap"
        out += [
            F.when(ok, F.element_at("q", 2 * i + 1)).alias(f"{label}_lower"),
            F.when(ok, F.element_at("q", 2 * i + 2)).alias(f"{label}_upper"),
            status.alias(f"{label}_status"),
        ]
    return found.withColumn("_key", F.from_json("key", names)).select(*out)


def _paired(left, right, keys):
    """Full outer pairing that stops on an unmatched or repeated side."""

    def one(df, name):
        return df.groupBy(*keys).agg(
            F.first("value").alias(name), F.count(F.lit(1)).alias(f"{name}_n")
        )

    rows = one(left, "_l").join(one(right, "_r"), list(keys), "full_outer")
    matched = (F.col("_l_n") == 1) & (F.col("_r_n") == 1)
    stop = F.raise_error(F.lit("paired groups are unmatched or repeated"))
    return rows.withColumn("_l", F.when(matched, F.col("_l")).otherwise(stop))


def _effects(paired, keys, policy, population, factor=1.0):
    """Mean difference, both means and both intervals per series."""
    difference = F.col("_l") - F.lit(float(factor)) * F.col("_r")
    values = cut(paired.select(*keys, "group_id", difference.alias("value"), "_l", "_r"))
    series = [k for k in keys if k not in population]
    means = values.groupBy(*keys).agg(F.avg("_l").alias("left"), F.avg("_r").alias("right"))
    intervals = bootstrap_ci(values.drop("_l", "_r"), series, policy, population)
    return intervals.join(means, list(keys)).withColumnRenamed("mean", "difference")


def _against(group_rows, base, keys):
    """Every model's group rows beside the reference's, on the same groups.

    The reference joins on series and group; a repeated row, or a model whose groups
    are not exactly the reference's, stops the job.
    """
    own = group_rows.groupBy("model", *keys, "group_id").agg(
        F.first("value").alias("_l"), F.count(F.lit(1)).alias("_l_n")
    )
    series = Window.partitionBy(*keys)
    other = (
        base.groupBy(*keys, "group_id")
        .agg(F.first("value").alias("_r"), F.count(F.lit(1)).alias("_r_n"))
        .withColumn("_groups", F.count(F.lit(1)).over(series))
    )
    rows = own.join(other, [*keys, "group_id"], "left").withColumn(
        "_met", F.count("_r_n").over(Window.partitionBy("model", *keys))
    )
    matched = (F.col("_l_n") == 1) & (F.col("_r_n") == 1) & (F.col("_met") == F.col("_groups"))
    stop = F.raise_error(F.lit("a model's groups are not those of the reference"))
    return rows.withColumn("_l", F.when(F.coalesce(matched, F.lit(False)), F.col("_l")).otherwise(stop))


def compare(group_rows, reference, policy):
    """Each model's group MAE against the reference on the same groups.

    A zero reference gives a null ratio. The interval is family-corrected.
    """
    keys = [*CELL, "feature_id", "step"]
    group_rows = cut(group_rows)
    base = group_rows.filter(F.col("model") == reference).drop("model")
    paired = _against(group_rows, base, keys)
    effects = _effects(paired, ["model", *keys], policy, CELL)
    ratio = F.col("left") / F.nullif("right", F.lit(0.0))
    return effects.select(
        "model",
        F.lit(reference).alias("reference"),
        *keys,
        F.col("difference").alias("mae_difference"),
        ratio.alias("ratio"),
        (1 - ratio).alias("improvement"),
        F.col("corrected_lower").alias("ci_lower"),
        F.col("corrected_upper").alias("ci_upper"),
        "groups",
        F.col("corrected_status").alias("status"),
    )


def paired_effects(variant, reference, policy, keys=(*CELL, "step")):
    """Variant minus reference group MAE per lead, both intervals."""
    keys = list(keys)
    paired = _paired(variant, reference, [*keys, "group_id"])
    population = [k for k in CELL if k in keys] or keys
    return _effects(paired, keys, policy, population).withColumnRenamed(
        "difference", "mae_difference"
    )


def select_statistics(metrics, models):
    """Lowest aggregate MAE per feature and step; ties by model id."""
    rows = metrics.filter(
        (F.col("level") == "aggregate") & (F.col("metric") == "mae") & F.col("model").isin(*models)
    )
    best = F.min_by(F.struct("model", "value"), F.struct("value", "model"))
    return rows.groupBy(*CELL, "feature_id", "step").agg(best.alias("_b")).select(
        *CELL, "feature_id", "step", "_b.model", "_b.value"
    )


def selected_effects(group_rows, choices, model, policy):
    """A model against the statistic frozen for each feature and step."""
    keys = [*CELL, "feature_id", "step"]
    group_rows = cut(group_rows)
    chosen = choices.select(*keys, F.col("model").alias("reference"))
    base = (
        group_rows.join(chosen, keys)
        .filter(F.col("model") == F.col("reference"))
        .drop("model", "reference")
    )
    mine = group_rows.filter(F.col("model") == model).drop("model")
    effects = _effects(_paired(mine, base, [*keys, "group_id"]), keys, policy, CELL)
    return effects.join(chosen, keys).select(
        F.lit(model).alias("model"),
        "reference",
        *keys,
        F.col("difference").alias("mae_difference"),
        (F.col("left") / F.nullif("right", F.lit(0.0))).alias("ratio"),
        "marginal_lower",
        "marginal_upper",
        "corrected_lower",
        "corrected_upper",
        "groups",
        F.col("corrected_status").alias("status"),
    )


def paired_effect(left, right, policy, factor=1.0, keys=CELL):
    """Left minus factor times right per group, both intervals."""
    keys = list(keys)
    population = [k for k in CELL if k in keys] or keys
    return _effects(_paired(left, right, [*keys, "group_id"]), keys, policy, population, factor)
