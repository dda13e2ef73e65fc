import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspan.functions import quantiles as qt
from rollspan.operators import coupling as cp
from rollspan.operators import inference as inf
from rollspan.operators import points as pt
from rollspan.operators import series as sr
from rollspan.operators import windows as wn
from tests import data


def table(spark, *series):
    rows = [(f"t{i}", t, float(v)) for i, s in enumerate(series) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "trajectory_id string, frame long, position double")


@pytest.mark.parametrize("fixture", [None, "short_blocks"])
def test_quality_control(spark, request, fixture):
    if fixture:
        request.getfixturevalue(fixture)
    frames = table(spark, range(6), [0, 0, 10, 0, 0, 0], [0.3] * 6)
    qc = sr.feature_qc(frames, {"position": 0.1}, 2, 1.0)
    by = {r["trajectory_id"]: r for r in qc.collect()}
    ramp = by["t0"]
    assert ramp["quantiles"] == [0, 1.25, 2.5, 3.75, 5]
    assert ramp["variance"] == pytest.approx(35 / 12)
    assert ramp["acf"] == pytest.approx([1, 0.5, 1 / 17.5])
    assert (ramp["decay_frames"], ramp["decay_censored"]) == (2, False)
    assert ramp["drift"] == pytest.approx(1) and ramp["jumps"] == 0
    assert ramp["half_shift"] == pytest.approx(3 / math.sqrt(35 / 12))
    assert (by["t1"]["jumps"], by["t1"]["increments"]) == (2, 5)
    flat = by["t2"]
    assert flat["constant"] and flat["near_constant"] and flat["acf"] is None
    assert flat["decay_frames"] is None and not flat["decay_censored"]
    assert flat["half_shift"] is None and flat["std"] == 0


def test_short_acf(spark, short_blocks):
    curve = sr.acf(table(spark, [0, 1, 2]), 10).first()["acf"]
    assert curve == pytest.approx([1, 0, -0.5])


def test_long_acf_over_blocks(spark, short_blocks):
    values = np.random.default_rng(1).normal(size=37)
    curve = sr.acf(table(spark, values), 9).first()["acf"]
    c = values - values.mean()
    want = [float(c[: 37 - k] @ c[k:] / (c @ c)) for k in range(10)]
    assert curve == pytest.approx(want)


def test_group_dependence(spark):
    policy = inf.Policy(seed=1, samples=200, min_groups=5, min_tail=1)
    wave = [0, 1] * 20
    frames = table(spark, *[wave] * 12)
    groups = frames.select("trajectory_id").distinct().withColumn(
        "group_id", F.floor(F.substring("trajectory_id", 2, 9).cast("int") / 2).cast("string")
    )
    out = sr.dependence_summary(sr.acf(frames, 10), groups, 10, policy)
    by = {(r["measure"], r["lag"]): r for r in out.collect()}
    decay = by[("decay", -1)]
    assert (decay["value"], decay["ci_lower"], decay["ci_upper"]) == (1, 1, 1)
    assert by[("integrated", -1)]["value"] == 0.5
    assert by[("censored", -1)]["value"] == 0 and by[("censored", -1)]["ci_lower"] is None
    assert decay["groups"] == 6 and decay["trajectories"] == 12
    times = sr.correlation_times(sr.acf(table(spark, range(100)), 2), 2).first()
    assert (times["decay"], times["censored"]) == (2, True)


def test_cross_correlation(spark):
    frames = table(spark, range(6)).withColumn("twice", F.col("position") * 2).withColumn(
        "flat", F.lit(0.3)
    )
    out = {(r["feature_a"], r["feature_b"]): r["correlation"]
           for r in sr.cross_correlation(frames).collect()}
    assert len(out) == 9
    assert out[("position", "twice")] == pytest.approx(1) and out[("flat", "flat")] is None


def pairs(spark, a, b):
    rows = [("t", 0, len(a), 1, "s", "g", [float(x) for x in a], [float(x) for x in b])]
    return spark.createDataFrame(
        rows,
        "trajectory_id string, start long, context_frames int, horizon_frames int, "
        "system_id string, group_id string, a array<double>, b array<double>",
    )


def test_lag_direction_and_gain(spark):
    a = np.random.default_rng(3).normal(size=60)
    b = np.append(0.0, a[:-1])
    both = pairs(spark, a, b)
    lags = {r["lag"]: r["correlation"] for r in cp.lag_correlation(both, 2).collect()}
    assert lags[1] == pytest.approx(1) and abs(lags[-1]) < 0.9
    one = cp.lag_gain(both, 1, 1e-6).first()["gain"]
    assert one > 0.99
    assert cp.lag_gain(both, 1, 0.0).first()["gain"] == pytest.approx(one, abs=1e-4)
    assert cp.lag_gain(both, 2, 1.0).first()["gain"] > 0.9
    flat = pairs(spark, [1.0] * 12, [2.0] * 12)
    assert cp.lag_gain(flat, 1, 1.0).first()["gain"] is None
    assert cp.lag_gain(flat, 2, 1.0).first()["gain"] is None
    assert {r["correlation"] for r in cp.lag_correlation(flat, 2).collect()} == {None}


def test_quantiles_are_exact_at_any_range(spark):
    rng = np.random.default_rng(4)
    groups = {
        "wide": np.exp(rng.normal(size=400) * 8),
        "ties": np.repeat([1.0, 2.0, 7.0], 100),
        "flat": np.full(90, 3.0),
        "tiny": np.array([4.0, 1.0]),
        "signs": np.concatenate([-np.exp(rng.normal(size=50)), [0.0, -0.0], np.exp(rng.normal(size=50))]),
        "small": np.array([5e-324, 1e-310, -5e-324, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    levels = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    out = qt.exact_quantiles(df, ["k"], "v", levels)
    got = {r["k"]: r["quantiles"] for r in out.collect()}
    for k, values in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(values, levels)), rel=1e-12)


def test_quantiles_of_extreme_and_unfit_values(spark):
    wide = spark.createDataFrame([("k", -1e308), ("k", 1e308), ("k", None)], "k string, v double")
    assert qt.exact_quantiles(wide, ["k"], "v", (0.0, 0.5, 1.0)).first()["quantiles"] == [-1e308, 0.0, 1e308]
    for bad in (float("nan"), float("inf")):
        df = spark.createDataFrame([("k", 1.0), ("k", bad)], "k string, v double")
        with pytest.raises(Exception, match="finite"):
            qt.exact_quantiles(df, ["k"], "v", (0.5,))


def cloud(spark):
    x = [0.0, 10.0, 4.0, 4.0, 14.0, 0.0]
    rows = [
        ("t", f, "s", i, v + (f if i in (3, 4) else 0), 0.0, 0.0)
        for f in range(3) for i, v in enumerate(x)
    ]
    coords = spark.createDataFrame(
        rows,
        "trajectory_id string, frame long, system_id string, atom int, x double, y double, z double",
    )
    atoms = spark.createDataFrame(
        [("s", i, n) for i, n in enumerate([6, 8, 1, 6, 7, 1])],
        "system_id string, atom int, atomic_number int",
    )
    segments = spark.createDataFrame([("s", 0), ("s", 3)], "system_id string, start int")
    return coords, atoms, segments


def test_contact_channels(spark):
    coords, atoms, segments = cloud(spark)
    points = pt.label_points(coords, pt.heavy_sets(atoms, segments))
    rows = pt.contact_channels(points, 4.0).orderBy("frame").collect()
    assert [(r["contacts"], r["fraction"], r["minimum"]) for r in rows] == [
        (2, 1, 4), (0, 0, 5), (1, 0, 4),
    ]
    sides = spark.createDataFrame([("s", 0, "receptor"), ("s", 3, "ligand")],
                                  "system_id string, atom int, side string")
    apart = pt.region_distance(coords, sides).orderBy("frame").collect()
    assert [r["minimum"] for r in apart] == [4, 5, 6]
    with pytest.raises(Exception):
        pt.reference_fraction(points, 1.0).collect()
    with pytest.raises(Exception):
        pt.heavy_sets(atoms.withColumn("atomic_number", F.lit(1)), segments).unionByName(
            pt.heavy_sets(atoms, segments.withColumn("start", F.lit(0)))
        ).collect()


@pytest.mark.parametrize("slab", [64, 1])
@pytest.mark.parametrize("periodic", [False, True])
def test_geometry_against_all_pairs(spark, monkeypatch, periodic, slab):
    """Also with frames cut into slabs of one radius."""
    monkeypatch.setattr(pt, "SLAB", slab)
    rng = np.random.default_rng(5)
    box = 3.0
    rows, truth = [], {}
    for f in range(4):
        xyz = rng.uniform(-2, 4, size=(30, 3)) * (1 if f < 3 else 4)
        rows += [("t", f, "s", i, "receptor" if i < 20 else "ligand", *map(float, p), box, box, box)
                 for i, p in enumerate(xyz)]
        gap = xyz[:20, None] - xyz[None, 20:]
        if periodic:
            gap = gap - box * np.floor(gap / box + 0.5)
        d = np.sqrt((gap**2).sum(-1))
        truth[f] = (int((d <= 1.1).sum()), float(d.min()))
    points = spark.createDataFrame(
        rows, "trajectory_id string, frame long, system_id string, atom int, side string, "
        "x double, y double, z double, lx double, ly double, lz double",
    )
    counts = {r["frame"]: r["contacts"] for r in pt.contacts(points, 1.1, periodic).collect()}
    least = {r["frame"]: r["minimum"] for r in pt.min_distance(points, periodic).collect()}
    for f, (n, d) in truth.items():
        assert counts[f] == n and least[f] == pytest.approx(d)


def test_regions_and_radius(spark):
    xs = [0, 1, 2, 3, 12, 13, 14]
    static = spark.createDataFrame(
        [("s", i, i, "CA", 6, i == 0, float(x), 0.0, 0.0) for i, x in enumerate(xs)],
        "system_id string, atom int, residue int, name string, atomic_number int, ligand boolean, "
        "x double, y double, z double",
    )
    out = {r["residue"]: r["region"] for r in pt.select_regions(static).collect()}
    assert out == {1: "pocket", 2: "pocket", 3: "pocket", 4: "distal", 5: "distal", 6: "distal"}
    with pytest.raises(Exception):
        pt.select_regions(static.withColumn("name", F.lit("C"))).collect()
    coords = spark.createDataFrame(
        [("t", 0, "s", i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 2, 10, 12, 14])],
        "trajectory_id string, frame long, system_id string, atom int, x double, y double, z double",
    )
    regions = spark.createDataFrame(
        [("s", i, "pocket" if i < 3 else "distal") for i in range(6)],
        "system_id string, atom int, region string",
    )
    radii = {r["region"]: r["radius"] for r in pt.radius_of_gyration(coords, regions).collect()}
    assert radii["distal"] == pytest.approx(math.sqrt(8 / 3))
    assert radii["pocket"] == pytest.approx(math.sqrt(2 / 3))


def test_one_sided_and_coincident_frames(spark):
    rows = [("t", 0, 0, "receptor", 1.0), ("t", 0, 1, "receptor", 2.0), ("t", 1, 0, "receptor", 1.0), ("t", 1, 5, "ligand", 1.0)]
    points = spark.createDataFrame(
        [(t, f, "s", a, side, x, 0.0, 0.0) for t, f, a, side, x in rows],
        "trajectory_id string, frame long, system_id string, atom int, side string, x double, y double, z double",
    )
    assert {r["frame"]: r["contacts"] for r in pt.contacts(points, 0.5).collect()} == {0: 0, 1: 1}
    assert [(r["frame"], r["minimum"]) for r in pt.min_distance(points).collect()] == [(1, 0.0)]


@pytest.mark.parametrize("inside", [1_000_000, 20])
def test_narrowed_quantiles(spark, monkeypatch, inside):
    """Large groups are sketched again inside their intervals; ties end the narrowing."""
    monkeypatch.setattr(qt, "INSIDE", inside)
    rng = np.random.default_rng(9)
    groups = {"n": rng.normal(size=6000), "ties": np.repeat([1.0, 5.0], 3000), "few": np.array([2.0, 9.0, 4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    levels = (0.0, 0.123, 0.5, 0.77, 1.0)
    got = {r["k"]: r["quantiles"] for r in qt.exact_quantiles(df, ["k"], "v", levels).collect()}
    for k, values in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(values, levels)), rel=1e-12)


def test_ranks_outside_their_interval_are_found(spark, monkeypatch):
    """A misleading sketch costs a second look, not a wrong value."""
    monkeypatch.setattr(qt, "_grid", lambda value: F.array(*[F.lit(-5.0)] * (qt.CELLS + 1)))
    df = spark.range(300).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert qt.exact_quantiles(df, ["k"], "v", (0.25, 0.5)).first()["quantiles"] == [74.75, 149.5]


@pytest.mark.parametrize("level, rise", [(0.0, 0.0), (1e9, 0.0), (0.0, 1e7)])
def test_summaries_merge_like_the_whole_series(spark, short_blocks, level, rise):
    rng = np.random.default_rng(3)
    x = level + rise * np.arange(23) + rng.normal(size=23)
    merged = sr.merged_summaries(sr.block_summaries(table(spark, list(map(float, x))), 6), 6).first()
    d, c = np.diff(x), x - x.mean()
    assert merged["n"] == 23 and merged["increments"] == 22
    assert merged["mean"] == pytest.approx(x.mean(), rel=1e-12)
    assert merged["std"] == pytest.approx(x.std(), rel=1e-6)
    assert merged["drift"] == pytest.approx(np.polyfit(np.arange(23), x - level, 1)[0], rel=1e-5, abs=1e-6)
    assert merged["acf"] == pytest.approx([float((c[k:] * c[: 23 - k]).sum() / (c * c).sum()) for k in range(7)], abs=1e-5)
    assert merged["step_mean"] == pytest.approx(d.mean(), rel=1e-6, abs=1e-6)
    assert merged["step_std"] == pytest.approx(d.std(), rel=1e-5)
