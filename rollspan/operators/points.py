"""Pair geometry of labelled point clouds.

No operator forms all pairs of a frame. Per-frame channels work on packed frames: one
row holds both sides of a frame, receptor points sorted by the key of their cell (at
least as wide as the search radius), and each ligand point finds its neighbours by
ordered search of the cells around it, for a whole batch of frames at once. A frame
wider than SLAB radii is cut into slabs, with the ligand points near a slab's faces
copied across, so a row stays small and every pair is met once. Pairs as a table
(`near_pairs`) come from an equi join on (trajectory, frame, cell).
"""

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspan.functions.blocks import block_of
from rollspan.session import cut

FRAME = ["trajectory_id", "frame"]
AXES = ("x", "y", "z")
BOX = ("lx", "ly", "lz")
SLAB = 64  # search radii to a slab
SALTS = 32  # copies of per-system and per-trajectory rows, so a long trajectory meets many
AXIS_CELLS = 1 << 15
MARGIN = 1 + 1e-9  # on radii where points are dealt out, so rounding loses no pair


def heavy_sets(atoms, segments):
    """Receptor and ligand atoms heavier than hydrogen, per system.

    The ligand starts at the last segment; a system with an empty side stops the job.
    """
    boundary = segments.groupBy("system_id").agg(F.max("start").alias("_from"))
    heavy = atoms.filter(F.col("atomic_number") > 1).join(boundary, "system_id")
    side = F.when(F.col("atom") < F.col("_from"), "receptor").otherwise("ligand")
    system = Window.partitionBy("system_id")
    sided = heavy.select("system_id", "atom", side.alias("side"))
    both = (F.min("side").over(system) == "ligand") & (F.max("side").over(system) == "receptor")
    stop = F.raise_error(F.lit("a system needs heavy receptor and ligand atoms"))
    return sided.withColumn("_both", both).select(
        "system_id", "atom", F.when(F.col("_both"), F.col("side")).otherwise(stop).alias("side")
    )


def _salted(rows):
    return rows.withColumn("_salt", F.pmod(block_of(F.col("frame")) + F.col("frame"), F.lit(SALTS)))


def _copies(table):
    """A copy of each row of a static table for every salt."""
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return table.withColumn("_salt", F.explode(every))


def label_points(coords, sides):
    """Coordinates of the chosen atoms with their side."""
    return _salted(coords).join(_copies(sides), ["system_id", "_salt", "atom"]).select(
        *FRAME, "system_id", "atom", "side", *AXES
    )


def _squared(gaps):
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _gap(left, right, box=None):
    d = left - right
    return d if box is None else d - box * F.floor(d / box + 0.5)


def near_pairs(points, radius, periodic=False):
    """Receptor-ligand pairs no further apart than `radius` (a column of `points`).

    With `periodic`, `points` carries the box lengths lx, ly, lz of its frame, cells
    divide the box evenly and distances take the nearest image.
    """
    rows = points.withColumn("_r", radius)
    keys = [*FRAME, "_cx", "_cy", "_cz"]
    if periodic:
        def count(axis):
            return F.greatest(F.lit(1), F.floor(F.col(f"l{axis}") / F.col("_r"))).cast("long")

        def cell(axis):
            box = F.col(f"l{axis}")
            inside = F.col(axis) - box * F.floor(F.col(axis) / box)
            place = F.floor(inside / (box / count(axis))).cast("long")
            return F.greatest(F.lit(0).cast("long"), F.least(count(axis) - 1, place))
    else:
        def cell(axis):
            return F.floor(F.col(axis) / F.col("_r")).cast("long")

    for axis in AXES:
        rows = rows.withColumn(f"_c{axis}", cell(axis))
        if periodic:
            rows = rows.withColumn(f"_n{axis}", count(axis))
    left = rows.filter(F.col("side") == "receptor").select(
        *keys, "_r", F.col("atom").alias("a"), *[F.col(x).alias(f"_a{x}") for x in AXES],
        *([F.col(f"l{x}").alias(f"_b{x}") for x in AXES] if periodic else []),
    )
    right = rows.filter(F.col("side") == "ligand")
    for axis in AXES:
        around = [F.col(f"_c{axis}") + d for d in (-1, 0, 1)]
        if periodic:
            around = [F.pmod(c, F.col(f"_n{axis}")) for c in around]
        right = right.withColumn(f"_c{axis}", F.explode(F.array_distinct(F.array(*around))))
    right = right.select(
        *keys, F.col("atom").alias("b"), *[F.col(x).alias(f"_p{x}") for x in AXES]
    )
    gaps = [
        _gap(F.col(f"_a{x}"), F.col(f"_p{x}"), F.col(f"_b{x}") if periodic else None) for x in AXES
    ]
    return (
        left.join(right, keys)
        .withColumn("distance", F.sqrt(_squared(gaps)))
        .filter(F.col("distance") <= F.col("_r"))
        .select(*FRAME, "a", "b", "distance")
    )


def _wrapped(axis):
    box = F.col(f"l{axis}")
    return F.when(box.isNull(), F.col(axis)).otherwise(F.col(axis) - box * F.floor(F.col(axis) / box))


def _with_bound(points, keys):
    """Add `_bound`: the distance of one close pair per frame, found in linear work.

    From the first ligand atom to its nearest receptor atom, and from there to the
    nearest ligand atom: a true pair distance, so the minimum cannot exceed it.
    """
    frame, place = Window.partitionBy(*keys), F.struct(*AXES)
    ligand, receptor = F.col("side") == "ligand", F.col("side") == "receptor"

    def squared(anchor):
        gaps = []
        for x in AXES:
            d, box = F.col(x) - F.col(f"{anchor}.{x}"), F.col(f"l{x}")
            gaps.append(F.when(box.isNull(), d).otherwise(d - box * F.floor(d / box + 0.5)))
        return _squared(gaps)

    started = points.withColumn(
        "_at", F.min_by(F.when(ligand, place), F.when(ligand, F.col("atom"))).over(frame)
    )
    order = F.when(receptor, F.struct(squared("_at").alias("d"), F.col("atom").alias("a")))
    closed = started.withColumn("_to", F.min_by(F.when(receptor, place), order).over(frame))
    nearest = F.min(F.when(ligand, squared("_to"))).over(frame)
    return closed.withColumn("_bound", F.sqrt(nearest)).drop("_at", "_to")


def packed_frames(points, cutoff, minimum, keys):
    """One row per frame and slab: both sides' points, the frame's bound and its box."""
    absent = [F.lit(None).cast("double").alias(c) for c in BOX if c not in points.columns]
    rows = points.select("*", *absent).repartition(*keys)
    rows = _with_bound(rows, keys) if minimum else rows.withColumn("_bound", F.lit(None).cast("double"))
    reach = F.greatest(F.lit(float(cutoff or 0.0)), F.coalesce("_bound", F.lit(0.0))) * F.lit(MARGIN)
    thick = F.when(F.col("_reach") > 0, F.col("_reach") * SLAB)
    slabs = F.when(F.col("lx").isNotNull(), F.greatest(F.lit(1), F.coalesce(F.floor(F.col("lx") / thick), F.lit(1))))
    rows = rows.withColumn("_reach", reach).withColumn("_slabs", slabs)
    rows = rows.withColumn("_thick", F.coalesce(F.col("lx") / F.col("_slabs"), thick)).withColumn("_w", _wrapped("x"))

    slab = lambda place: F.coalesce(F.floor(place / F.col("_thick")), F.lit(0)).cast("long")
    ring = lambda at: F.when(F.col("_slabs").isNull(), at).otherwise(F.pmod(at, F.col("_slabs")))
    around = F.array_distinct(
        F.transform(
            F.sequence(slab(F.col("_w") - F.col("_reach")), slab(F.col("_w") + F.col("_reach"))), ring
        )
    )
    where = F.when(F.col("side") == "receptor", F.array(ring(slab(F.col("_w"))))).otherwise(around)
    point = F.struct("atom", *AXES)
    return (
        rows.withColumn("_slab", F.explode(where))
        .groupBy(*keys, "_slab")
        .agg(
            F.collect_list(F.when(F.col("side") == "receptor", point)).alias("receptor"),
            F.collect_list(F.when(F.col("side") == "ligand", point)).alias("ligand"),
            F.first("_bound").alias("bound"),
            *[F.first(c).alias(c) for c in BOX],
        )
    )


class _Side:
    """One side of a batch of packed frames as flat arrays."""

    def __init__(self, lists):
        bounds = np.asarray(lists.offsets)
        values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        self.row = np.repeat(np.arange(len(lists)), np.diff(bounds))
        self.atom = np.asarray(values.field("atom")).astype(np.int64)
        self.at = np.stack([np.asarray(values.field(x)).astype(float) for x in AXES], axis=1)

    def cells(self, low, size, n):
        at = (self.at - low[self.row]) / size[self.row]
        return np.clip(np.floor(at).astype(np.int64), 0, n[self.row] - 1)


def _keys(row, cells):
    key = row.astype(np.int64)
    for axis in range(3):
        key = key << 16 | cells[:, axis]
    return key


def _close_pairs(receptor, ligand, radius, box):
    """(row, receptor place, ligand place, distance) of all pairs within their row's radius.

    Receptor keys are sorted; the cells around a ligand point are looked up one offset
    at a time. `box` is infinite for open axes; closed ones take the nearest image.
    """
    closed, rows = np.isfinite(box), len(radius)
    low, high = np.full((rows, 3), np.inf), np.full((rows, 3), -np.inf)
    for side in (receptor, ligand):
        np.minimum.at(low, side.row, side.at)
        np.maximum.at(high, side.row, side.at)
    with np.errstate(all="ignore"):
        extent = np.where(closed, box, high - low)
        n = np.floor(extent / (radius[:, None] * MARGIN))
        n = np.clip(np.nan_to_num(n, nan=1, posinf=AXIS_CELLS, neginf=1), 1, AXIS_CELLS).astype(np.int64)
        size = np.where((n > 1) & (extent > 0), extent / n, np.inf)
    n[np.isinf(size)] = 1
    low = np.where(closed | ~np.isfinite(low), 0, low)
    for side in (receptor, ligand):
        limits = box[side.row]
        with np.errstate(invalid="ignore"):
            side.at = np.where(np.isfinite(limits), side.at - limits * np.floor(side.at / limits), side.at)
    keys = _keys(receptor.row, receptor.cells(low, size, n))
    order = np.argsort(keys, kind="stable")
    keys, cells = keys[order], ligand.cells(low, size, n)
    found, shut, count = [], closed[ligand.row], n[ligand.row]
    for step in itertools.product((-1, 0, 1), repeat=3):
        step = np.array(step)
        there = cells + step
        met = np.where(shut, count >= np.where(step == -1, 3, np.where(step == 1, 2, 1)), (there >= 0) & (there < count))
        some = np.flatnonzero(met.all(axis=1))
        wanted = _keys(ligand.row[some], there[some] % count[some])
        first, last = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        runs = last - first
        if not runs.sum():
            continue
        b = np.repeat(some, runs)
        a = order[np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]
        gap, limits = receptor.at[a] - ligand.at[b], box[ligand.row[b]]
        with np.errstate(invalid="ignore"):
            gap = np.where(np.isfinite(limits), gap - limits * np.floor(gap / limits + 0.5), gap)
        distance = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])
        near = distance <= radius[ligand.row[b]]
        found.append((ligand.row[b][near], a[near], b[near], distance[near]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(c) for c in zip(*found))


def _searched(cutoff, minimum, pairs, names):
    """Counts, smallest distances and pairs (receptor atom above ligand atom) of packed rows."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            receptor, ligand = (_Side(batch.column(c)) for c in ("receptor", "ligand"))
            box = np.stack([np.asarray(batch.column(c).fill_null(np.inf)) for c in BOX], axis=1)
            bound = np.asarray(batch.column("bound").fill_null(-1.0)) if minimum else np.full(rows, -1.0)
            reach = np.maximum(bound, -1.0 if cutoff is None else cutoff)
            row, a, b, distance = _close_pairs(receptor, ligand, reach, box)
            best = np.full(rows, np.inf)
            np.minimum.at(best, row, distance)
            best = np.minimum(best, np.where(bound < 0, np.inf, bound))
            near = distance <= (-1.0 if cutoff is None else cutoff)
            row, code = row[near], receptor.atom[a[near]] << 32 | ligand.atom[b[near]]
            counts = np.bincount(row, minlength=rows)
            order = np.argsort(row, kind="stable") if pairs else np.zeros(0, np.int64)
            bounds = np.append(0, np.cumsum(counts if pairs else np.zeros(rows, np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in names],
                    pa.array(counts),
                    pa.array(best, mask=np.isinf(best)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(code[order])),
                ],
                names=[*names, "contacts", "minimum", "pairs"],
            )

    return run


def frame_channels(points, cutoff=None, minimum=False, pairs=False, keys=FRAME):
    """Contacts within `cutoff`, the minimum distance and the contact pairs of each frame.

    `points` may carry the frame's box lengths lx, ly, lz; a null box is open. A frame
    whose points are all on one side has no contacts and a null minimum.
    """
    keys = list(keys)
    packed = packed_frames(points, cutoff, minimum, keys)
    types = T.StructType([points.schema[k] for k in keys])
    for name, kind in (("contacts", T.LongType()), ("minimum", T.DoubleType()), ("pairs", T.ArrayType(T.LongType()))):
        types.add(name, kind)
    found = packed.select(*keys, "receptor", "ligand", "bound", *BOX).mapInArrow(
        _searched(cutoff, minimum, pairs, keys), types
    )
    columns = [F.sum("contacts").alias("contacts"), F.min("minimum").alias("minimum")]
    if pairs:
        columns.append(F.flatten(F.collect_list("pairs")).alias("pairs"))
    return found.groupBy(*keys).agg(*columns)


def _boxed(points, periodic):
    return points if periodic else points.drop(*BOX)


def _fractions(found, keys):
    """Add `fraction`: the share of the frame-0 pairs that a frame still has."""
    series = [k for k in keys if k != "frame"]
    initial = found.filter(F.col("frame") == 0).select(*series, F.col("pairs").alias("_initial"))
    size = F.size("_initial")
    share = F.size(F.array_intersect("pairs", "_initial")) / size
    return (
        _salted(found)
        .join(_copies(initial), [*series, "_salt"], "left")
        .withColumn(
            "fraction",
            F.when(size > 0, share).otherwise(
                F.raise_error(F.lit("no frame-0 contacts: the fraction is undefined"))
            ),
        )
        .drop("_salt", "_initial")
    )


def contacts(points, cutoff, periodic=False):
    """Pairs within the cutoff (inclusive) per frame; frames without any count 0."""
    return frame_channels(_boxed(points, periodic), cutoff).select(*FRAME, "contacts")


def reference_fraction(points, cutoff, periodic=False):
    """Share of the frame-0 contact pairs still in contact.

    A trajectory without a frame-0 contact stops the job. The frames' pairs are written
    out: they are compared with those of frame 0.
    """
    found = cut(frame_channels(_boxed(points, periodic), cutoff, pairs=True))
    return _fractions(found, FRAME).select(*FRAME, "fraction")


def contact_channels(points, cutoff, periodic=False):
    """P2-P4 together: contacts, fraction and minimum per frame, from one search."""
    found = cut(frame_channels(_boxed(points, periodic), cutoff, minimum=True, pairs=True))
    return _fractions(found, FRAME).select(*FRAME, "contacts", "fraction", "minimum")


def min_distance(points, periodic=False):
    """Exact smallest receptor-ligand distance per frame that has both sides.

    Cells are as wide as an upper bound of the answer, so the neighbouring ones hold the
    closest pair.
    """
    found = frame_channels(_boxed(points, periodic), minimum=True)
    return found.filter(F.col("minimum").isNotNull()).select(*FRAME, "minimum")


def region_distance(coords, regions):
    """P5: minimum distance between two named atom sets (side receptor and ligand)."""
    return min_distance(label_points(coords, regions))


@dataclass(frozen=True)
class RegionRules:
    """Residue distances that make a pocket or a distal region."""

    pocket: float = 6.0
    distal: float = 12.0
    min_atoms: int = 3


def select_regions(static_atoms, rules=RegionRules()):
    """Pocket and distal residues of each system's first structure.

    `static_atoms`: system_id, atom, residue, name, atomic_number, ligand, x, y, z.
    Only pairs within the distal radius are met; a residue without one is distal.
    Each residue needs exactly one C-alpha and each region enough residues.
    """
    heavy = static_atoms.filter(F.col("atomic_number") > 1).select(
        F.col("system_id").alias("trajectory_id"),
        F.lit(0).alias("frame"),
        "atom",
        F.when(F.col("ligand"), "ligand").otherwise("receptor").alias("side"),
        *AXES,
    )
    found = near_pairs(heavy, F.lit(float(rules.distal)))
    reach = found.groupBy(F.col("trajectory_id").alias("system_id"), F.col("a").alias("atom")).agg(
        F.min("distance").alias("_d")
    )
    alpha = F.col("name") == "CA"
    residues = (
        static_atoms.filter(~F.col("ligand"))
        .join(reach, ["system_id", "atom"], "left")
        .groupBy("system_id", "residue")
        .agg(
            F.min("_d").alias("distance"),
            F.count_if(alpha).alias("_alphas"),
            F.min(F.when(alpha, F.col("atom"))).alias("atom"),
        )
    )
    atom = F.when(F.col("_alphas") == 1, F.col("atom")).otherwise(
        F.raise_error(F.lit("a residue needs exactly one C-alpha"))
    )
    region = F.when(F.col("distance") <= rules.pocket, "pocket").when(
        F.col("distance").isNull() | (F.col("distance") >= rules.distal), "distal"
    )
    chosen = residues.select("system_id", "residue", atom.alias("atom"), region.alias("region"))
    counts = chosen.groupBy("system_id").agg(
        F.count_if(F.col("region") == "pocket").alias("_p"),
        F.count_if(F.col("region") == "distal").alias("_q"),
    )
    enough = F.least("_p", "_q") >= rules.min_atoms
    return (
        chosen.join(counts, "system_id")
        .filter(F.col("region").isNotNull())
        .select(
            "system_id", "residue", "atom",
            F.when(enough, F.col("region"))
            .otherwise(F.raise_error(F.lit("too few C-alpha atoms in a region")))
            .alias("region"),
        )
    )


def radius_of_gyration(coords, regions):
    """Unweighted radius of gyration per frame and region, one aggregate."""
    static = _copies(regions.select("system_id", "atom", "region"))
    return (
        _salted(coords).join(static, ["system_id", "_salt", "atom"])
        .groupBy(*FRAME, "region")
        .agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("radius"))
    )


def periodic_audit(points, boxes, cutoff):
    """Raw against minimum-image contacts, fractions and minima per trajectory.

    `boxes` holds orthorhombic lengths lx, ly, lz per frame. Each point stands for its
    open and its closed frame, so both are searched in one pass.
    """
    keys = [*FRAME, "closed"]
    both = points.join(boxes, FRAME).withColumn("closed", F.explode(F.array(F.lit(False), F.lit(True))))
    for c in BOX:
        both = both.withColumn(c, F.when(F.col("closed"), F.col(c)))
    found = cut(frame_channels(both, cutoff, minimum=True, pairs=True, keys=keys))
    channels = _fractions(found, keys)

    def of(name, closed):
        return F.max(F.when(F.col("closed") == closed, F.col(name)))

    frames = channels.groupBy(*FRAME).agg(
        *[of(n, c).alias(f"_{n}{int(c)}") for n in ("contacts", "fraction", "minimum") for c in (False, True)]
    )
    return frames.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("_contacts0") != F.col("_contacts1")).alias("count_different_frames"),
        F.count_if(F.col("_fraction0") != F.col("_fraction1")).alias("fraction_different_frames"),
        F.max(F.abs(F.col("_minimum0") - F.col("_minimum1"))).alias("max_minimum_difference"),
    )
