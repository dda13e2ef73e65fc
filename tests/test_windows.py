import pytest
from pyspark.sql import functions as F

from rollspan.functions import blocks
from rollspan.operators import contracts as ct
from rollspan.operators import scaling as sc
from rollspan.operators import splits as sp
from rollspan.operators import windows as wn
from tests import data


def keys(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_train_windows_and_regions(spark):
    table = data.trajectories(spark)
    grid = wn.Grid((1, 3), (1, 2), 2)
    index = wn.windows(table, data.assignments(table), grid, "train")
    assert index.count() == 24
    sparse = wn.Grid((1,), (1,), 2)
    regions = wn.context_regions(wn.windows(table, data.assignments(table), sparse, "train"))
    assert keys(regions.filter("trajectory_id = 'trajectory-0'"), "start", "stop") == [
        (0, 1), (2, 3), (4, 5),
    ]
    frames = data.frames(spark, lambda i, t: t + 10 * i)
    fitted = sc.fit_scaler(frames, regions, ["position", "constant"]).collect()
    assert {r["sample_count"] for r in fitted} == {9}
    assert {r["feature_id"]: r["scale"] for r in fitted}["constant"] == 1.0


def test_blocks_change_nothing(spark, monkeypatch):
    table = data.trajectories(spark, frames=23)
    frames = data.frames(spark, lambda i, t: (t * 7 + i) % 11, length=23)
    grid = wn.Grid((2, 5), (1, 3), 3)

    def run():
        index = wn.windows(table, data.assignments(table), grid)
        arrays = wn.window_arrays(frames, index, ["position"], grid.span)
        sparse = wn.windows(table, data.assignments(table), wn.Grid((2,), (1,), 5))
        return (
            keys(arrays, "trajectory_id", "start", "context_frames", "horizon_frames",
                 "context", "target"),
            keys(wn.context_regions(index), "trajectory_id", "start", "stop"),
            keys(wn.context_regions(sparse), "trajectory_id", "start", "stop"),
            keys(sc.fit_scaler(frames, wn.context_regions(sparse), ["position"]), "sample_count"),
            ct.counted(ct.validate_frames(frames, table, ["position"])).collect(),
        )

    whole = run()
    monkeypatch.setattr(blocks, "BLOCK", 4)
    assert run() == whole
    for _, start, c, h, context, target in whole[0]:
        assert (len(context), len(target)) == (c, h)
    assert whole[4] == []


def test_impossible_cell_fails_the_request(spark):
    table = data.trajectories(spark)
    with pytest.raises(ValueError):
        wn.windows(table, data.assignments(table), wn.Grid((5,), (2,), 1), "train")
    table_rows = wn.feasibility(table, wn.Grid((5,), (1, 2), 1)).collect()
    assert sorted((r["window_count"], r["reason"] is None) for r in table_rows)[0] == (0, False)
    assert max(r["window_count"] for r in table_rows) == 1


def test_physical_grid(spark):
    table = (
        data.trajectories(spark, frame_interval_ps=80.0, duration_ns=0.4)
        .withColumn("time_unit", F.lit("ps"))
        .withColumn("sampling_status", F.lit("verified"))
    )
    grid = wn.Grid((160.0,), (160.0,), 1, unit="ps")
    cell = wn.resolve_grid(table, grid).first()
    assert (cell["context_frames"], cell["horizon_frames"]) == (3, 2)
    assert wn.feasibility(table, grid).first()["window_count"] == 2
    off = wn.resolve_grid(table, wn.Grid((100.0,), (160.0,), 1, unit="ps")).first()
    assert off["reason"] == "not aligned to the interval"
    assert ct.counted(ct.validate_time_axis(table)).count() == 0


def test_input_conditions(spark):
    rows = data.arrays(spark, ([0, 1, 2, 3, 4], [5]))
    both = rows.unionByName(rows.withColumn("feature_id", F.lit("aux")))
    out = {r["feature_id"]: r["context"] for r in
           wn.input_condition(both, "x", "shifted", 3).collect()}
    assert out == {"x": [0, 1, 2, 3, 4], "aux": [2, 3, 4, 0, 1]}
    assert wn.input_condition(both, "x", "target-only").count() == 1
    with pytest.raises(Exception):
        wn.input_condition(both, "x", "shifted", 5).collect()


def test_transitive_components(spark):
    table = data.trajectories(spark)
    joined = table.withColumn(
        "system_id", F.when(F.col("trajectory_id") == "trajectory-1", "system-0").otherwise(F.col("system_id"))
    ).withColumn(
        "split_group_id",
        F.when(F.col("trajectory_id") == "trajectory-2", "group-1").otherwise(F.col("split_group_id")),
    )
    labels = table.select(
        "trajectory_id",
        F.when(F.col("trajectory_id") == "trajectory-3", "trajectory-2")
        .otherwise(F.col("trajectory_id")).alias("label"),
    )
    groups = {r["trajectory_id"]: r["group_id"] for r in sp.components(joined, labels).collect()}
    assert [groups[f"trajectory-{i}"] for i in range(6)] == ["trajectory-0"] * 4 + [
        "trajectory-4", "trajectory-5",
    ]
    with pytest.raises(ValueError):
        sp.official_split(joined, sp.components(joined, labels))


def test_long_chain_of_components(spark):
    n = 60
    table = data.trajectories(spark, n=n, splits=["train"] * n)
    number = F.substring("trajectory_id", 12, 9).cast("int")
    chained = table.withColumn("split_group_id", F.floor(number / 2).cast("string")).withColumn(
        "system_id", F.floor((number + 1) / 2).cast("string")
    )
    labels = table.select("trajectory_id", F.col("trajectory_id").alias("label"))
    assert sp.components(chained, labels).select("group_id").distinct().count() == 1


def test_grouped_split_counts(spark):
    groups = data.trajectories(spark).select(
        "trajectory_id", F.col("trajectory_id").alias("group_id")
    )
    out = sp.grouped_split(groups, (1 / 2, 1 / 3, 1 / 6), 4)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {
        "train": 3, "validation": 2, "test": 1,
    }
    five = spark.createDataFrame([(5,)], "groups long")
    parts = sp.apportion(sp.split_quotas(spark, (0.5, 0.3, 0.2)), five).collect()
    assert [(r["split"], r["n"], r["first"]) for r in parts] == [
        ("train", 3, 0), ("validation", 1, 3), ("test", 1, 4),
    ]
    with pytest.raises(Exception, match="no dependency group"):
        sp.grouped_split(groups.limit(1), (0.5, 0.3, 0.2), 4).collect()
    with pytest.raises(ValueError):
        sp.grouped_split(groups, (0.5, 0.3, 0.1), 4)


def test_missing_label_refuses_components(spark):
    table = data.trajectories(spark)
    labels = table.filter("trajectory_id != 'trajectory-2'").select(
        "trajectory_id", F.col("trajectory_id").alias("label")
    )
    with pytest.raises(Exception, match="no label"):
        sp.components(table, labels).collect()


def test_one_label_for_all_is_one_component(spark):
    table = data.trajectories(spark)
    labels = table.select("trajectory_id", F.lit("all").alias("label"))
    assert sp.components(table, labels).select("group_id").distinct().count() == 1


def test_impossible_cell_is_refused_and_listed(spark):
    table = data.trajectories(spark)
    grid = wn.Grid((3, 400), (2,), 1)
    with pytest.raises(ValueError, match="impossible cell"):
        wn.windows(table, data.assignments(table), grid)
    cells, rejected = wn.admit(table, data.assignments(table), grid)
    assert {r["context"] for r in rejected.collect()} == {400}
    assert rejected.count() == cells.count() == table.count()


def test_regions_meet_each_frame_once(spark, short_blocks):
    frames = data.frames(spark, lambda i, t: t)
    regions = frames.filter("frame % 2 = 0").select(
        "trajectory_id", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop")
    )
    inside = sc.in_regions(frames, regions)
    assert inside.count() == regions.count()
    assert "frame" in inside._jdf.queryExecution().optimizedPlan().toString()


def test_replica_split(spark):
    rows = data.trajectories(spark).withColumn("split", F.lit(None).cast("string"))
    number = F.substring("trajectory_id", 12, 9).cast("int")
    rows = rows.withColumn("system_id", F.floor(number / 3).cast("string")).withColumn(
        "replicate_id", (number % 3 + 1).cast("string")
    )
    groups = rows.select("trajectory_id", F.col("system_id").alias("group_id"))
    roles = {"1": "train", "2": "train", "3": "test"}
    out = sp.replica_split(rows, groups, roles)
    assert keys(out.filter("split = 'test'"), "trajectory_id") == [
        ("trajectory-2",), ("trajectory-5",),
    ]
    with pytest.raises(ValueError):
        sp.replica_split(rows, groups, {"1": "train", "2": "test"})


def test_held_out_values_do_not_reach_the_scaler(spark):
    table = data.trajectories(spark)
    grid = wn.Grid((3,), (2,), 1)
    frames = data.frames(spark, lambda i, t: t + 10 * i)
    poisoned = frames.withColumn(
        "position",
        F.when(F.col("trajectory_id").isin("trajectory-3", "trajectory-5") | (F.col("frame") > 3), 1e9)
        .otherwise(F.col("position")),
    )
    regions = wn.context_regions(wn.windows(table, data.assignments(table), grid, "train"))
    fit = lambda f: sc.fit_scaler(f, regions, ["position"]).collect()
    assert fit(frames) == fit(poisoned)


def test_series_contract_finds_each_fault(spark, short_blocks):
    table = data.trajectories(spark)
    good = data.frames(spark, lambda i, t: t)
    at = lambda i, t: (F.col("trajectory_id") == f"trajectory-{i}") & (F.col("frame") == t)
    faults = {
        "finite": good.withColumn("position", F.when(at(0, 5), float("nan")).otherwise(F.col("position"))),
        "time-order": good.withColumn("time", F.when(at(1, 4), 3.0).otherwise(F.col("time"))),
        "time-origin": good.withColumn("time", F.when(at(2, 0), -1.0).otherwise(F.col("time"))),
        "frame-count": good.filter(~at(3, 5)),
        "frame-order": good.filter(~at(3, 2)),
    }
    for rule, frames in faults.items():
        rules = {r["rule"] for r in ct.validate_frames(frames, table).collect()}
        assert rule in rules, (rule, rules)
    assert ct.validate_frames(good, table).count() == 0


def test_regions_in_one_pass(spark, short_blocks):
    frames = spark.range(30).select(F.lit("a").alias("trajectory_id"), F.col("id").alias("frame"), F.lit(1.5).alias("x"))
    regions = [(0, 2), (1, 3), (5, 5), (6, 15), (7, 8), (14, 17), (29, 40)]
    df = spark.createDataFrame([("a", *r) for r in regions] + [("b", 0, 9)], "trajectory_id string, start long, stop long")
    inside = sc.in_regions(frames, df)
    assert inside.columns == frames.columns
    assert sorted(r["frame"] for r in inside.collect()) == sorted({f for lo, hi in regions for f in range(lo, hi) if f < 30})


def test_first_windows_without_windows(spark):
    table = data.trajectories(spark)
    cells, _ = wn.admit(table, data.assignments(table), wn.Grid((9, 3, 2), (2, 1), 1))
    got = {(r["trajectory_id"], r["start"], r["context_frames"], r["horizon_frames"]) for r in wn.first_windows(cells).collect()}
    assert got == {(f"trajectory-{i}", 0, 2, 1) for i in range(6)}
