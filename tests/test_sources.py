import pytest
from pyspark.sql import functions as F

from rollspan.functions.hashing import fingerprint, hash_rank
from rollspan.operators import cohorts as ch
from rollspan.operators import contracts as ct
from rollspan.operators import forecasts as fc
from rollspan.operators import windows as wn
from rollspan.session import scratch
from rollspan.sources import bundle
from rollspan.sources import series as ss
from tests import data


def test_series_round_trip_and_refusal(spark):
    path = scratch(spark)
    table = data.trajectories(spark)
    frames = data.frames(spark, lambda i, t: t).withColumn("dataset_id", F.lit("d"))
    ss.write_frames(frames, table, path, ["position", "constant"])
    stored = ss.read_frames(spark, path, ["position", "constant"])
    assert fingerprint(stored) == fingerprint(frames.select(stored.columns))
    with pytest.raises(Exception):
        ss.write_frames(frames, table, path, ["position", "constant"])
    broken = frames.withColumn("position", F.lit(float("nan")))
    with pytest.raises(ValueError):
        ss.write_frames(broken, table, scratch(spark), ["position", "constant"])


def test_fingerprint_ignores_order_and_counts_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "n int, s string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("n")).repartition(3))
    assert fingerprint(a) != fingerprint(a.distinct())
    assert fingerprint(a.limit(0)) != fingerprint(a)


def test_export_reasons(spark):
    table = data.trajectories(spark, n=2).withColumn(
        "system_id", F.when(F.col("trajectory_id") == "trajectory-0", "1AAA").otherwise("1DDD")
    )
    requested = spark.createDataFrame([("1AAA",), ("1CCC",), ("9ZZZ",)], "system_id string")
    splits = ss.split_lists(
        {"train": spark.createDataFrame([("1AAA",), ("1CCC",)], "value string")}
    )
    frames, registry, issues = ss.export_systems(
        data.frames(spark, lambda i, t: t), table, requested, splits
    )
    assert {r["system_id"]: r["status"] for r in issues.collect()} == {
        "1CCC": "missing", "9ZZZ": "dropped",
    }
    assert registry.first()["split"] == "train" and frames.count() == 6


def test_official_lists_are_strict(spark):
    lines = lambda *ids: spark.createDataFrame([(i,) for i in ids], "value string")
    with pytest.raises(ValueError):
        ss.split_lists({"train": lines("1AAA"), "test": lines("1AAA")})
    with pytest.raises(ValueError):
        ss.split_lists({"train": lines("1aaa")})


def test_replica_admission(spark, short_blocks):
    frames = spark.createDataFrame(
        [(f"t{r}", i, 200.0 * i + 210 + (1 if (r, i) == (1, 5) else 0)) for r in range(3)
         for i in range(10 - (r == 2))],
        "trajectory_id string, frame long, time double",
    )
    sources = spark.createDataFrame(
        [(f"t{r}", f"s{r // 2}", 10, 200.0) for r in range(4)],
        "trajectory_id string, system_id string, frame_count int, frame_interval_ps double",
    )
    admitted, registry, issues = ss.admit_replicas(frames, sources)
    assert {r["trajectory_id"]: r["reason"] for r in issues.collect()} == {
        "t1": "spacing differs from the declared interval",
        "t2": "frame count differs", "t3": "absent from input",
    }
    times = [r["time"] for r in admitted.orderBy("frame").collect()]
    assert times == [200.0 * i for i in range(10)]
    assert registry.first()["duration_ns"] == pytest.approx(1.8)
    kept, logged = ss.drop_failed_groups(sources, issues, "system_id")
    assert kept.count() == 0 and logged.count() == 4


def test_feature_sets_must_share_the_axis(spark):
    a = data.frames(spark, lambda i, t: t).drop("constant")
    b = data.frames(spark, lambda i, t: t).drop("position")
    assert ss.join_feature_sets(a, b).count() == 36
    with pytest.raises(Exception):
        ss.join_feature_sets(a, b.filter("frame < 5")).collect()
    with pytest.raises(Exception):
        ss.join_feature_sets(a, b.withColumn("time", F.col("time") * 2)).collect()


def test_identity_keys(spark):
    df = spark.createDataFrame(
        [("d", "a b/c", "x", "1")],
        "dataset_id string, source_system string, source_trajectory string, replicate_id string",
    )
    row = ss.with_ids(df).first()
    assert row["system_id"] == "d:system:a%20b%2Fc"
    assert row["trajectory_id"] == "trajectory:d%3Asystem%3Aa%2520b%252Fc:x:1"
    with pytest.raises(Exception):
        ss.with_ids(df.withColumn("source_system", F.lit(" a"))).collect()


def test_cohort_rules(spark):
    splits = {"1AAA": "train", "2BBB": "validation", "3CCC": "validation", "4DDD": "test", "5EEE": "test"}
    official = spark.createDataFrame(list(splits.items()), "id string, split string")
    excluded = spark.createDataFrame([("5EEE",)], "id string")
    counts = {"train": 1, "validation": 1, "calibration": 1, "confirmation": 1}
    roles = ch.select_cohort(official, official, excluded, counts, 9)
    ch.require_counts(roles, counts)
    assert {r["role"] for r in roles.collect()} == set(counts)
    assert ct.validate_cohort(roles, official, excluded, counts).count() == 0
    with pytest.raises(ValueError):
        ch.require_counts(roles, {**counts, "train": 2})
    with pytest.raises(ValueError):
        ch.select_cohort(official, official, excluded, {**counts, "train": 2}, 9)
    altered = roles.withColumn("role", F.lit("train"))
    rules = {r["rule"] for r in ct.validate_cohort(altered, official, excluded, counts).collect()}
    assert rules == {"official-split", "role-count"}
    table = data.trajectories(spark)
    named = spark.createDataFrame(
        [(f"system-{i}", r) for i, r in enumerate(["train", "validation", "calibration",
                                                   "confirmation"])],
        "system_id string, role string",
    )
    frames = data.frames(spark, lambda i, t: t)
    ids = lambda purpose: {
        r["trajectory_id"]
        for r in ss.read_for_purpose(frames, table, named, purpose).select("trajectory_id").collect()
    }
    assert ids("tuning") == {"trajectory-0", "trajectory-1"}
    assert ids("confirmation") == {"trajectory-3"}


def test_hash_rank_is_global(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    ranked = hash_rank(df, F.sha2("id", 256), ["id"], "rank").withColumn("h", F.sha2("id", 256))
    rows = ranked.orderBy("h").collect()
    assert [r["rank"] for r in rows] == list(range(500))


def test_bundle_detects_a_change(spark):
    table = spark.createDataFrame([("m", 1, 1, 0.5)], "model string, context_frames int, "
                                  "horizon_frames int, value double")
    path = scratch(spark)
    bundle.write_bundle({name: table for name in bundle.TABLES}, path)
    assert set(bundle.read_bundle(spark, path)) == set(bundle.TABLES)
    table.write.partitionBy("context_frames", "horizon_frames").mode("append").parquet(f"{path}/metrics")
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, path)


def test_file_verification(spark):
    path = scratch(spark)
    spark.range(3).coalesce(1).write.parquet(path)
    digests = bundle.file_digests(spark, path, "*.parquet")
    manifest = digests.select("name", "size", F.lit("sha256").alias("algorithm"),
                              F.col("sha256").alias("digest"))
    assert bundle.verify_files(digests, manifest).count() == 0
    bad = manifest.withColumn("digest", F.lit("0"))
    assert bundle.verify_files(digests, bad).first()["reason"] == "digest differs"
    short = manifest.withColumn("size", F.lit(1).cast("long"))
    assert bundle.verify_files(digests, short).first()["reason"] == "size differs"
    assert bundle.verify_files(digests, manifest.limit(0)).first()["reason"] == "unlisted"


def test_outside_forecasts_must_cover_the_windows(spark):
    table = data.trajectories(spark)
    index = wn.windows(table, data.assignments(table), wn.Grid((3,), (2,), 1), "test")
    arrays = wn.window_arrays(data.frames(spark, lambda i, t: t), index, ["position"], 5)
    rows = fc.predictions(fc.forecast(arrays, {"p": fc.persistence})).drop("model", "point")
    rows = rows.withColumn("levels", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).withColumn(
        "quantiles", F.array(F.col("target") - 1, F.col("target"), F.col("target") + 1)
    )
    out = bundle.register_forecasts(rows, "outside", index)
    assert out.filter(F.col("point") != F.col("target")).count() == 0
    with pytest.raises(ValueError):
        bundle.register_forecasts(rows.filter("start > 0"), "outside", index)
    crossed = rows.withColumn("quantiles", F.reverse("quantiles"))
    with pytest.raises(ValueError):
        bundle.register_forecasts(crossed, "outside", index)


def test_catalogue_and_overlap(spark):
    projects = spark.createDataFrame(
        [
            ('{"accession":"B","mdcount":10,"metadata":{"PDBIDS":["1abc"],'
             '"LICENSE":"Creative Commons Attribution 4.0"}}',),
            ('{"accession":"A","mdcount":10,"metadata":{"PDBIDS":["1ABC"],'
             '"LICENSE":"the Creative Commons Attribution 4.0 licence"}}',),
            ('{"accession":"C","mdcount":9,"metadata":{"PDBIDS":["2ABC"],'
             '"LICENSE":"Creative Commons Attribution 4.0"}}',),
            ('{"accession":"D","mdcount":10,"metadata":{"PDBIDS":["3ABC"],'
             '"LICENSE":"Creative Commons Attribution 4.0"}}',),
        ],
        "value string",
    )
    out = ss.scan_catalog(projects, spark.createDataFrame([("3ABC",)], "id string")).collect()
    assert [(r["id"], r["accession"]) for r in out] == [("1ABC", "A")]
    a = spark.createDataFrame([("x", ["s1", "s2"]), ("y", ["s3"])], "id string, seq array<string>")
    b = spark.createDataFrame([("z", ["s2", "s9"])], "id string, seq array<string>")
    flags = {r["id"]: r["seq_shared"] for r in ch.overlap_audit(a, b, ["seq"]).collect()}
    assert flags == {"x": True, "y": False}


def test_malformed_catalogue_stops(spark):
    projects = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception):
        ss.scan_catalog(projects, spark.createDataFrame([], "id string")).collect()


def test_altered_split_is_refused(spark):
    table = data.trajectories(spark)
    frames = data.frames(spark, lambda i, t: t)
    roles = table.select("system_id", F.lit("train").alias("role")).distinct()
    official = table.select(F.col("system_id").alias("id"), "split").distinct()
    assert ss.read_for_purpose(frames, table, roles, "tuning", official).count() == frames.count()
    altered = official.withColumn("split", F.lit("elsewhere"))
    with pytest.raises(ValueError, match="official split"):
        ss.read_for_purpose(frames, table, roles, "tuning", altered)


def scoped(spark):
    path = scratch(spark)
    table = data.trajectories(spark).withColumn("source_checksum", F.lit("bytes"))
    frames = data.frames(spark, lambda i, t: t)
    ss.write_scoped(frames, table, path)
    official = table.select(F.col("system_id").alias("id"), "split").distinct()
    role = F.when(F.col("split") == "test", "confirmation").otherwise(F.col("split"))
    return path, table, official, table.select("system_id", role.alias("role"))


def test_scoped_reads_prune_folders(spark):
    path, table, official, roles = scoped(spark)
    faults = ss.record_faults(table, table, "d", "bytes", official)
    read = lambda purpose: ss.read_scoped(spark, path, ["position", "constant"], table, roles, purpose, faults)
    tuning, confirmed = read("tuning"), read("confirmation")
    assert tuning.count() == 30 and {r["trajectory_id"] for r in confirmed.collect()} == {"trajectory-5"}
    plan = confirmed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "test" in plan
    files = {f.split("/split=")[1].split("/")[0] for f in confirmed.inputFiles()}
    assert files <= {"test", "train", "validation"}
    with pytest.raises(Exception, match="no registered trajectory"):
        ss.write_scoped(data.frames(spark, lambda i, t: t), table.filter("trajectory_id <> 'trajectory-0'"), scratch(spark))


@pytest.mark.parametrize(
    "column, value, reason",
    [
        ("trajectory_id", "elsewhere", "unknown record"), ("dataset_id", "other", "dataset differs"),
        ("source_checksum", "changed", "source differs"), ("split", "test", "official split differs"),
        ("frame_count", 5, "altered record"), ("license_id", "none", "altered record"),
    ],
)
def test_faulty_records_are_refused_before_reading(spark, column, value, reason):
    path, table, official, roles = scoped(spark)
    first = F.col("trajectory_id") == "trajectory-0"
    kind = dict(table.dtypes)[column]
    given = table.withColumn(column, F.when(first, F.lit(value).cast(kind)).otherwise(F.col(column)))
    faults = ss.record_faults(given, table, "d", "bytes", official)
    assert [r["reason"] for r in faults.collect()] == [reason]
    with pytest.raises(ValueError, match="frozen cohort"):
        ss.read_scoped(spark, path, ["position"], given, roles, "tuning", faults)
    assert ss.read_scoped(spark, path, ["position"], given, roles, "confirmation", faults).count() == 6


def test_an_altered_bundle_table_is_named(spark):
    table = spark.createDataFrame([("m", 1, 1, 0.5), ("m", 1, 2, 0.25)], "model string, context_frames int, "
                                  "horizon_frames int, value double")
    path, other = scratch(spark), scratch(spark)
    bundle.write_bundle({name: table for name in bundle.TABLES}, path)
    assert {(r["table"], r["rows"], r["intact"]) for r in bundle.check_bundle(spark, path).collect()} == {
        (name, 2, True) for name in bundle.TABLES
    }
    assert spark.read.parquet(f"{path}/fingerprints").select("fingerprint").distinct().first()[0] == fingerprint(table)
    bundle.write_bundle({name: table for name in bundle.TABLES}, other)
    changed = table.withColumn("value", F.col("value") + 1)
    changed.write.partitionBy("context_frames", "horizon_frames").mode("overwrite").parquet(f"{other}/runtime")
    assert [r["table"] for r in bundle.check_bundle(spark, other).filter("not intact").collect()] == ["runtime"]
    with pytest.raises(ValueError, match="runtime"):
        bundle.read_bundle(spark, other)


def test_large_files_are_streamed(spark, tmp_path):
    import hashlib

    parts = {"a b.bin": b"x" * 100_000, "small.bin": b"y"}
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in bundle.file_digests(spark, str(tmp_path), "*.bin", row_limit=50).collect()}
    for name, content in parts.items():
        assert (got[name]["size"], got[name]["sha256"], got[name]["md5"]) == (
            len(content), hashlib.sha256(content).hexdigest(), hashlib.md5(content).hexdigest(),
        )


def test_cleared_tables_are_built_again(spark):
    from rollspan import session
    from rollspan.plans import testbed as tb

    key = (spark.sparkContext.applicationId, "folder", "name")
    tb._STORED[key] = spark.range(1)
    for forget in session._CLEARED:
        forget(spark)
    assert key not in tb._STORED


def test_coverage_of_groups_that_lack_windows(spark):
    table = data.trajectories(spark)
    index = wn.windows(table, data.assignments(table), wn.Grid((2,), (1,), 1))
    scored = index.crossJoin(spark.createDataFrame([("a",), ("b",)], "model string")).withColumn("feature_id", F.lit("x")).withColumn("step", F.lit(1))
    assert ct.check_coverage(scored, index).count() == 0
    gone = F.col("start") == 1
    assert ct.check_coverage(scored.filter(~(gone & (F.col("model") == "a"))), index).count() == 0
    rules = lambda rows, of=index: sorted({r["rule"] for r in ct.check_coverage(rows, of).collect()})
    assert rules(scored.filter(~gone)) == ["missing"]
    assert rules(scored, index.filter(~gone)) == ["extra"]
    assert rules(scored.unionByName(scored.filter(gone))) == ["repeated"]
    assert rules(scored.limit(0)) == ["missing"]


def test_fingerprints_digest_each_row_once(spark):
    """One digest a row, and sums equal to those of the digests' 32-bit limbs."""
    import hashlib

    from rollspan.functions.hashing import fingerprint_frame, observed_fingerprint

    table = spark.range(50).select(F.col("id").alias("n"), F.concat(F.lit("s"), "id").alias("s"))
    digests = [hashlib.sha256(f'{{"n":{i},"s":"s{i}"}}'.encode()).hexdigest() for i in range(50)]
    limbs = [sum(int(d[8 * i : 8 * i + 8], 16) for d in digests) for i in range(8)]
    want = hashlib.sha256("|".join(map(str, [50, *limbs])).encode()).hexdigest()
    assert fingerprint(table) == want
    watched, mark = observed_fingerprint(table)
    assert watched.columns == table.columns
    watched.write.format("noop").mode("overwrite").save()
    assert mark() == (50, want)
    assert fingerprint_frame(table).first().asDict() == {"rows": 50, "fingerprint": want}
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = watched._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("sha2(") == 1


def test_files_are_written_by_the_tasks(spark, tmp_path):
    lines = [("a b/%#é", "x"), ("a b/%#é", "y"), ("_c", "z")]
    table = spark.createDataFrame(lines, "name string, value string")
    assert bundle.write_files(table, str(tmp_path / "files"), 4) == 2
    found = bundle.file_digests(spark, str(tmp_path / "files"), "*.txt", bundle.file_name, 3)
    assert {(r["name"], r["size"]) for r in found.collect()} == {("a b/%#é", 4), ("_c", 2)}
    assert {p.read_text() for p in (tmp_path / "files").rglob("*.txt")} == {"x\ny\n", "z\n"}
    assert not [p for p in (tmp_path / "files").rglob("*") if p.name.startswith(("name=", "."))]


def chained(bundle, path, segment):
    """Bytes read in every round of `_advanced`, and the last round's row."""
    import pyarrow as pa

    schema = pa.schema({"path": pa.string(), "size": pa.int64(), "at": pa.int64(), "sha256": pa.binary(), "md5": pa.binary()})
    row, reads = {"path": f"file:{path}", "size": path.stat().st_size, "at": 0}, []
    while row["at"] < row["size"]:
        before = row["at"]
        (out,) = bundle._advanced([pa.RecordBatch.from_pylist([row], schema=schema)], segment)
        (row,) = out.to_pylist()
        reads.append(row["at"] - before)
    return reads, row


def test_a_task_reads_a_segment_of_a_large_file(spark, tmp_path, monkeypatch):
    """Hashes are carried on from task to task, at any place in a block of 64 bytes."""
    import hashlib

    contents = {f"{n}.bin": bytes(i * 7 % 251 for i in range(n)) for n in (64, 999, 1000, 1001, 4999)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {n: (len(c), hashlib.sha256(c).hexdigest(), hashlib.md5(c).hexdigest()) for n, c in contents.items()}
    found = bundle.file_digests(spark, str(tmp_path), "*.bin", row_limit=80, segment=1000)
    assert {r["name"]: (r["size"], r["sha256"], r["md5"]) for r in found.collect()} == want
    assert bundle.ROW_LIMIT <= bundle.SEGMENT < 1_500_000_000 / 4
    for segment in (1000, 64, 4999):
        reads, row = chained(bundle, tmp_path / "4999.bin", segment)
        assert max(reads) <= segment and sum(reads) == 4999
        assert (row["sha256"].hex(), row["md5"].hex()) == want["4999.bin"][1:]
    # Workers have no copy of the library: what a task calls travels with it.
    import subprocess
    import sys

    from pyspark.cloudpickle import dumps

    alone = "import sys, pickle; next(pickle.load(sys.stdin.buffer)([], 1), None)"
    subprocess.run([sys.executable, "-I", "-c", alone], input=dumps(bundle._advanced), check=True)
    monkeypatch.setattr(bundle, "_crypto", lambda: None)
    reads, row = chained(bundle, tmp_path / "4999.bin", 1000)
    assert reads == [4999] and row["sha256"].hex() == want["4999.bin"][1]


def test_large_files_do_not_meet_in_a_task(spark, tmp_path):
    from pyspark.sql import functions as F

    for i in range(6):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * 100)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.lit("n").alias("name"), F.col("length").alias("size"))
    rounds = []

    def kept(df):
        from rollspan.session import cut

        rounds.append(df.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().agg(F.max("count")).first()[0])
        return cut(df)

    plain, bundle.cut = bundle.cut, kept
    try:
        assert bundle._chained(files, 40).count() == 6
    finally:
        bundle.cut = plain
    assert rounds[1:] == [1, 1, 1]


def test_files_as_written_need_no_row_digests(spark):
    """A bundle's untouched files are known by their bytes; any others are judged by their rows."""
    table = spark.range(6).select(
        F.concat(F.lit("m"), "id").alias("model"), F.lit(1).alias("context_frames"),
        (F.col("id") % 2).cast("int").alias("horizon_frames"), (F.col("id") / 4).alias("value"),
    )
    path = scratch(spark)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    bundle.write_bundle({name: table for name in bundle.TABLES}, path)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole = lambda df: {(r["table"], r["rows"], r["intact"]) for r in df.collect()}
    checked = bundle.check_bundle(spark, path)
    assert "MapInArrow" not in plan(checked) and "to_json" not in plan(checked)
    assert whole(checked) == {(name, 6, True) for name in bundle.TABLES}
    table.repartition(3).write.partitionBy("context_frames", "horizon_frames").mode("overwrite").parquet(f"{path}/metrics")
    checked = bundle.check_bundle(spark, path)
    assert plan(checked).count("MapInArrow") == 1
    assert whole(checked) == {(name, 6, True) for name in bundle.TABLES}
    declared = spark.read.parquet(f"{path}/fingerprints")
    declared = spark.createDataFrame(declared.collect(), declared.schema)
    for changed, broken in (
        (declared.withColumn("fingerprint", F.when(F.col("table") == "runtime", "x").otherwise(F.col("fingerprint"))), ["runtime"]),
        (declared.withColumn("rows", F.when(F.col("table") == "runtime", 7).otherwise(F.col("rows"))), ["runtime"]),
        (declared.filter("table != 'runtime'"), ["runtime"]),
        (declared.drop("files"), []),
    ):
        changed.write.mode("overwrite").parquet(f"{path}/fingerprints")
        assert [r["table"] for r in bundle.check_bundle(spark, path).filter("not intact").collect()] == broken
