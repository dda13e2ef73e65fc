"""Exact linear-interpolated quantiles for groups of any size, guided by rank sketches.

A mergeable rank sketch gives, for every wanted rank of a group, a narrow interval that
should hold it. One exact pass then counts the values below each interval and the
distinct values inside it, which are few, and reads the ranks off those counts. Groups
whose intervals would still hold more than INSIDE values are sketched again inside
them, so what a task orders stays bounded; each round leaves about a twelfth. A rank
that is not where the sketch said is looked for once more in its whole group: the
sketch only steers, all counts are exact.

Rows are read once by each pass and never copied. Null values are left out; NaN and
infinite values stop the job.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions.checked import finite
from rollspan.session import cut

CELLS = 50  # cells of a sketch that is read as a grid
ACCURACY = 1000  # of the sketch: ranks are right within a thousandth
INSIDE = 1_000_000
SALTS = 16
INFINITE = float("inf")


def _grid(value):
    return F.percentile_approx(value, [j / CELLS for j in range(CELLS + 1)], ACCURACY)


def _met(rows, intervals, keys, levels):
    """Every row beside its group's intervals: level number, value and its place there."""
    bounds = intervals.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{c}{i}") for i in range(levels) for c in ("_lo", "_hi")]
    )
    copies = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS).cast("long"))).join(copies, [*keys, "_salt"])
    v = F.col("_v")
    each = [
        F.struct(
            F.lit(i).alias("_i"),
            (v <= F.col(f"_hi{i}")).alias("_kept"),
            F.when(v >= F.col(f"_lo{i}"), v).alias("_in"),
        )
        for i in range(levels)
    ]
    return joined.select(*keys, F.inline(F.array(*each))).filter("_kept").drop("_kept")


def _narrowed(state):
    """The state's intervals, cut down to the cells of its grid around the wanted ranks."""
    m, step = F.col("_m"), CELLS / F.col("_m")
    first = F.floor((F.col("_r0") - F.col("_base") - 1) * step - 1)
    last = F.ceil((F.col("_r1") - F.col("_base") + 1) * step + 1)
    at = lambda j: F.get("_grid", j.cast("int"))
    return state.select(
        "*",
        F.when((m > 0) & (first >= 0), at(first)).otherwise(F.col("_lo")).alias("_low"),
        F.when((m > 0) & (last <= CELLS), at(last)).otherwise(F.col("_hi")).alias("_high"),
    ).drop("_lo", "_hi", "_grid", "_base", "_m").withColumnsRenamed({"_low": "_lo", "_high": "_hi"})


def _sketched(rows, intervals, keys, levels):
    """Intervals with the exact count below them, inside them, and a grid of the inside."""
    found = _met(rows, intervals, keys, levels).groupBy(*keys, "_i").agg(
        F.count_if(F.col("_in").isNull()).alias("_base"), F.count("_in").alias("_m"), _grid("_in").alias("_grid")
    )
    return intervals.join(found, [*keys, "_i"])


def _read(rows, intervals, keys, levels):
    """The values at both ranks of every interval, null where a rank lies outside."""
    counts = _met(rows, intervals, keys, levels).groupBy(*keys, "_i", "_in").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_in"))
    upto = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = upto.join(intervals.select(*keys, "_i", "_r0", "_r1"), [*keys, "_i"])

    def at(rank):
        here = (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(here, F.col("_in")))

    return placed.groupBy(*keys, "_i").agg(at("_r0").alias("_v0"), at("_r1").alias("_v1"))


def exact_quantiles(df, keys, value, levels, name="quantiles"):
    """One array of quantiles per key."""
    keys, count = list(keys), len(levels)
    held = finite(F.col(value).cast("double"), "quantiles need finite values")
    rows = df.select(*keys, held.alias("_v")).filter(F.col("_v").isNotNull())
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _grid("_v").alias("_grid"))
    places = [
        F.struct(
            F.lit(i).alias("_i"),
            F.floor((F.col("_n") - 1) * F.lit(float(q))).alias("_r0"),
            F.ceil((F.col("_n") - 1) * F.lit(float(q))).alias("_r1"),
        )
        for i, q in enumerate(levels)
    ]
    state = cut(
        whole.select(*keys, "_n", "_grid", F.inline(F.array(*places))).select(
            "*",
            F.lit(-INFINITE).alias("_lo"),
            F.lit(INFINITE).alias("_hi"),
            F.lit(0).cast("long").alias("_base"),
            F.col("_n").alias("_m"),
        )
    )
    inside = state.agg(F.max("_m")).first()[0] or 0
    while inside * 6 // CELLS > INSIDE:
        state = cut(_sketched(rows, _narrowed(state), keys, count))
        now = state.agg(F.max("_m")).first()[0]
        if now == inside:  # equal values are one row of counts
            break
        inside = now
    intervals = cut(_narrowed(state))
    found = cut(intervals.join(_read(rows, intervals, keys, count), [*keys, "_i"], "left"))
    lost = found.filter(F.col("_v0").isNull() | F.col("_v1").isNull())
    if not lost.isEmpty():
        again = lost.select(*intervals.columns).drop("_lo", "_hi")
        again = again.withColumn("_lo", F.lit(-INFINITE)).withColumn("_hi", F.lit(INFINITE))
        again = again.join(_read(rows, again, keys, count), [*keys, "_i"])
        found = found.filter(F.col("_v0").isNotNull() & F.col("_v1").isNotNull()).unionByName(again)
    part = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in levels]), F.col("_i") + 1) - F.col("_r0")
    near = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part
    wide = F.abs(F.col("_v1") - F.col("_v0")) == F.lit(INFINITE)
    point = F.when(wide, F.col("_v0") * (1 - part) + F.col("_v1") * part).otherwise(near)
    points = found.select(*keys, F.struct("_i", point.alias("_p")).alias("_at"))
    return points.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list("_at")), lambda a: a["_p"]).alias(name)
    )
