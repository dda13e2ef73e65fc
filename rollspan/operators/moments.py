"""Closed-form forecasts from running sums instead of copied contexts.

Frames are cut into chunks as long as the longest context, and each block of frames
holds, beside its values, the running sums of d, i d, d^2 and d d[-1] inside every
chunk, where d is the value less the chunk's first one and i its place in the chunk. A
context of at most `chunk` frames touches one or two chunks, so its moments are one or
two differences of entries, joined like summaries of neighbouring pieces: the second
piece is shifted to the first one's level, and the product across the seam is added.
Sums restart with every chunk, so what is subtracted is never larger than a context.

A window's row carries ten numbers, whatever its context length; its targets are the
only values that are copied.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.functions import blocks as blk
from rollspan.functions.arrays import let
from rollspan.functions.blocks import block_of, with_blocks
from rollspan.operators.forecasts import ar1_path

SUMS = ("s", "t", "q", "p")


def running_moments(frames, features, chunk, span):
    """One row per (trajectory, block): its frames' values and running sums in order, `span` frames ahead."""
    rows = with_blocks(frames.select("trajectory_id", "frame", *features), after=span - 1)
    rows = rows.repartition("trajectory_id", "block").withColumn("_chunk", F.floor(F.col("frame") / chunk))
    order = Window.partitionBy("trajectory_id", "block", "_chunk").orderBy("frame")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy("trajectory_id", "block").orderBy("_chunk", "frame")
    place = F.col("frame") % chunk
    shifted = rows.select(
        "trajectory_id", "block", "_chunk", "frame",
        *[F.col(f).alias(f"_x_{f}") for f in features],
        *[(F.col(f) - F.first(f).over(upto)).alias(f"_d_{f}") for f in features],
        *[
            F.when(F.coalesce(F.col(f) != F.lag(f).over(block), F.lit(True)), F.col("frame")).alias(f"_n_{f}")
            for f in features
        ],
    )
    columns = []
    for f in features:
        d = F.col(f"_d_{f}")
        terms = (d, place * d, d * d, d * F.coalesce(F.lag(d).over(order), F.lit(0.0)))
        products = [(name, term) for name, term in zip(SUMS, terms)]
        columns.append((f, products))
    shifted = shifted.select(
        "*", *[term.alias(f"_term_{name}_{f}") for f, products in columns for name, term in products]
    )
    summed = shifted.select(
        "trajectory_id", "block", "frame",
        *[F.col(f"_x_{f}") for f in features],
        *[F.sum(f"_term_{name}_{f}").over(upto).alias(f"_{name}_{f}") for f in features for name in SUMS],
        *[F.max(f"_n_{f}").over(block.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_r_{f}") for f in features],
    )
    names = [c for c in summed.columns if c.startswith("_")]
    return summed.groupBy("trajectory_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("frame", *names))).alias("_rows")
    )


def _placed(rows, chunk):
    """Places of a context in its block's entries: where it and its one or two pieces begin and end."""
    at, c = F.col("_at"), F.col("_c")
    return rows.withColumns({
        "_at": (F.col("start") - F.col("block") * blk.BLOCK + 1).cast("int"),
        "_c": F.col("context_frames").cast("int"),
        "_place": (F.col("start") % chunk).cast("int"),
    }).withColumn("_n1", F.least(c, F.lit(chunk) - F.col("_place"))).withColumns({
        "_end": at + F.col("_n1") - 1,
        "_last": at + c - 1,
        "_two": F.col("_n1") < c,
        # What the first piece's chunk had summed before it; the block may begin inside a chunk.
        "_before": F.least(F.col("_place"), at - 1),
    })


def _pieces(f):
    """The one or two pieces of a context: counts, sums and the values at their ends.

    Each is one entry of the block's rows, taken out by its place, so a window costs the
    same whatever the length of its block.
    """
    at, end, last, two = F.col("_at"), F.col("_end"), F.col("_last"), F.col("_two")
    entry = lambda name, i: F.element_at("_rows", i).getField(f"_{name}_{f}")
    known = lambda name: F.when(F.col("_before") > 0, entry(name, at - 1)).otherwise(F.lit(0.0))
    return {
        "level": entry("x", at - F.col("_before")),
        "first": entry("x", at),
        "seam": entry("x", end),
        "level2": F.when(two, entry("x", end + 1)),
        "last": entry("x", last),
        **{f"{n}1": entry(n, end) - known(n) for n in ("s", "t", "q")},
        "p1": entry("p", end) - entry("p", at),
        **{f"{n}2": F.when(two, entry(n, last)).otherwise(F.lit(0.0)) for n in SUMS},
        "flat": entry("r", F.greatest(last - 1, F.lit(1))) <= F.col("start"),
        "target": F.slice("_rows", at + F.col("_c"), F.col("horizon_frames")).getField(f"_x_{f}"),
    }


def _joined(f):
    """Moments of the whole context about the first piece's level."""
    k = lambda name: F.col(f"_{name}_{f}")
    n, n1, two = F.col("_c").cast("double"), F.col("_n1").cast("double"), F.col("_two")
    place = F.col("_place").cast("double")
    n2 = n - n1
    shift = F.when(two, k("level2") - k("level")).otherwise(F.lit(0.0))
    last = k("last") - k("level") - shift  # about the second piece's own level
    seam = F.when(
        two,
        (k("seam") - k("level")) * shift
        + k("p2")
        + shift * (2 * k("s2") - last)
        + (n2 - 1) * shift * shift,
    ).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n"),
        k("level").alias("level"),
        k("first").alias("first"),
        k("last").alias("last"),
        (k("s1") + k("s2") + n2 * shift).alias("s"),
        (
            k("t1") - place * k("s1")
            + F.when(two, k("t2") + n1 * k("s2") + shift * (n1 * n2 + n2 * (n2 - 1) / 2)).otherwise(F.lit(0.0))
        ).alias("t"),
        (k("q1") + k("q2") + shift * (2 * k("s2") + n2 * shift)).alias("q"),
        (k("p1") + seam).alias("p"),
        k("flat").alias("flat"),
    )


def context_moments(frames, index, features, chunk, span):
    """One row per window and feature: the context's `moments` and the `target` values.

    `chunk` is the longest context of the grid; a longer one stops the job. Moments are
    about `level`: s, t, q and p sum d, i d, d^2 and d d[-1]; `flat` says that all values
    but the last are equal.
    """
    packed = running_moments(frames, features, chunk, span)
    if "block" not in index.columns:
        index = index.withColumn("block", block_of(F.col("start")))
    fits = F.when(F.col("context_frames") <= chunk, F.lit(True)).otherwise(
        F.raise_error(F.lit("a context is longer than the chunk of the running sums"))
    )
    rows = index.withColumn("_fits", fits).join(packed, ["trajectory_id", "block"]).filter("_fits")
    pieces = {f"_{name}_{f}": value for f in features for name, value in _pieces(f).items()}
    # Nothing above reads the block's rows: they are not copied for every window.
    rows = _placed(rows, chunk).withColumns(pieces).drop("_rows")
    channels = [
        F.struct(
            F.lit(f).alias("feature_id"),
            _joined(f).alias("moments"),
            F.col(f"_target_{f}").alias("target"),
        )
        for f in features
    ]
    keep = [name for name in index.columns if name != "block"]
    return rows.select(*keep, F.inline(F.array(*channels)))


def persistence(m, horizon):
    """the last observed value, H times."""
    return F.array_repeat(m["last"], horizon)


def context_mean(m, horizon):
    """the context mean, H times."""
    return F.array_repeat(m["level"] + m["s"] / m["n"], horizon)


def linear(m, horizon):
    """least-squares line over 0..C-1, evaluated at C..C+H-1."""
    middle = (m["n"] - 1) / 2
    line = F.struct(
        (m["level"] + m["s"] / m["n"]).alias("mean"),
        ((m["t"] - middle * m["s"]) / (m["n"] * (m["n"] * m["n"] - 1) / 12)).alias("slope"),
        (m["n"] - middle).alias("ahead"),
        horizon.cast("int").alias("h"),
    )
    points = let(
        line,
        lambda s: F.transform(
            F.sequence(F.lit(0), s["h"] - 1), lambda k: s["mean"] + s["slope"] * (s["ahead"] + k)
        ),
    )
    return F.when(m["n"] >= 2, points).otherwise(
        F.raise_error(F.lit("a linear forecast needs two observed frames"))
    )


def autoregression1(ridge=0.0):
    """F4 with p = 1, from the moments of the lagged and the leading values."""

    def model(m, horizon):
        first, last = m["first"] - m["level"], m["last"] - m["level"]
        known = F.struct(
            F.struct(
                (m["s"] - last).alias("x"),
                (m["s"] - first).alias("y"),
                (m["q"] - last * last).alias("xx"),
                m["p"].alias("xy"),
            ).alias("s"),
            (m["n"] - 1).alias("n"),
            m["level"].alias("f"),
            m["last"].alias("last"),
            horizon.cast("int").alias("h"),
            m["flat"].alias("flat"),
        )
        return F.when(m["n"] >= 3, ar1_path(known, ridge)).otherwise(
            F.raise_error(F.lit("too few observed frames for one lag"))
        )

    return model


def forecast_sets(rows, models):
    """F12, one row per window and feature: `forecasts` holds every candidate's points.

    Targets and keys are there once for all candidates, so this is the form to store.
    """
    horizon, m = F.col("horizon_frames"), F.col("moments")
    keep = [c for c in rows.columns if c != "moments"]
    outputs = [
        F.struct(F.lit(name).alias("model"), model(m, horizon).alias("points"))
        for name, model in models.items()
    ]
    return rows.select(*keep, m["last"].alias("origin"), F.array(*outputs).alias("forecasts"))


def each_model(sets):
    """A row per model of `forecast_sets`, which holds at least one.

    The outer form: below the plain one Spark tests that the array is not empty, and would
    work out every model's points a second time for it.
    """
    return sets.select(*[c for c in sets.columns if c != "forecasts"], F.inline_outer("forecasts"))


def forecast(rows, models):
    """F12 for models of moments: every candidate in one pass over the window rows."""
    return each_model(forecast_sets(rows, models))
