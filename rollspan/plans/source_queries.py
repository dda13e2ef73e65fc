"""Queries over sources, sinks, cohorts and their contracts."""

from urllib.parse import unquote

from pyspark.sql import functions as F

from rollspan.functions.hashing import fingerprint_frame
from rollspan.operators import cohorts as ch
from rollspan.operators import contracts as ct
from rollspan.operators import forecasts as fc
from rollspan.operators import losses as ls
from rollspan.operators import moments as mm
from rollspan.plans import forecast_queries as fq
from rollspan.plans import testbed as tb
from rollspan.plans.registry import query, rnd, rounded
from rollspan.plans.sql import CELL, EVENTS, r
from rollspan.session import cut, delete, scratch, spread
from rollspan.sources import bundle
from rollspan.sources import series as ss
from rollspan.tables import FEATURES, conform

COUNTS = {"train": 40, "validation": 8, "calibration": 6, "confirmation": 5}


def user():
    return F.substring("trajectory_id", 2, 20).cast("long")


@query(
    "s1_s2_series_round_trip",
    f"""WITH {EVENTS} SELECT trajectory_id, count(*) AS frames, {r("sum(value * (frame + 1))", 3)}
  AS value_sum, {r("sum(k)")} AS k_sum FROM ev GROUP BY ALL""",
)
def s1(spark, sf_dir):
    path = scratch(spark)
    frames = tb.event_frames(spark, sf_dir).withColumn("dataset_id", F.lit("events"))
    ss.write_frames(frames, tb.event_trajectories(spark, sf_dir), path, tb.EVENT_FEATURES)
    stored = ss.read_frames(spark, path, tb.EVENT_FEATURES).filter("dataset_id = 'events'")
    return stored.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("frames"),
        rnd(F.sum(F.col("value") * (F.col("frame") + 1)), 3).alias("value_sum"),
        rnd(F.sum("k")).alias("k_sum"),
    )


def feature_table(spark, note="standard"):
    """Definitions of the event channels as a `features` table."""
    rows = [
        ("value", 0, "dimensionless", "event value", "as recorded"),
        ("k", 1, "count", "property k", note),
    ]
    names = ("feature_id", "ordinal", "unit", "description", "definition")
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.lit("events").alias("dataset_id"), F.inline(F.array(*entries)))


@query(
    "s3_registry_round_trip",
    f"""WITH {EVENTS} SELECT trajectory_id, system_id, split_group_id, replicate_id, split,
  n::INTEGER AS frame_count, 2::BIGINT AS features FROM tr""",
)
def s3(spark, sf_dir):
    path = scratch(spark)
    ss.write_registry(
        tb.event_trajectories(spark, sf_dir), conform(feature_table(spark), FEATURES), path
    )
    trajectories, features = ss.read_registry(spark, path)
    per = features.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("features"))
    return trajectories.join(per, "dataset_id").select(
        "trajectory_id", "system_id", "split_group_id", "replicate_id", "split", "frame_count",
        "features",
    )


@query(
    "s4_split_lists",
    """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 <= 6 THEN 'train'
  WHEN c_custkey % 10 <= 8 THEN 'validation' ELSE 'test' END AS split FROM customer""",
)
def s4(spark, sf_dir):
    official, _, _ = tb.customers(spark, sf_dir)
    path = scratch(spark)
    paths = {}
    for split in ("train", "validation", "test"):
        paths[split] = f"{path}/{split}"
        official.filter(F.col("split") == split).select(F.col("id").cast("string")).write.text(
            paths[split]
        )
    return ss.read_split_lists(spark, paths, "^[0-9]+$")


def export_inputs(spark, sf_dir):
    users = tb.event_users(spark, sf_dir).select("user_id")
    requested = users.select(F.concat(F.lit("s"), "user_id").alias("system_id"))
    splits = users.filter(F.col("user_id") % 7 != 0).select(
        F.concat(F.lit("s"), "user_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("split"),
    )
    return ss.export_systems(
        tb.event_frames(spark, sf_dir), tb.event_trajectories(spark, sf_dir), requested, splits
    )


REQUESTED = f"""WITH {EVENTS}, rq AS (
  SELECT 's' || user_id AS system_id, user_id % 7 <> 0 AS official, user_id % 2 = 0 AS even,
    's' || user_id IN (SELECT system_id FROM tr) AS present FROM tr)"""


@query(
    "s5_export_issues",
    f"""{REQUESTED} SELECT system_id, CASE WHEN NOT official THEN 'dropped' ELSE 'missing' END
  AS status, CASE WHEN NOT official THEN 'not in official splits' ELSE 'absent from input' END
  AS reason FROM rq WHERE NOT official OR NOT present""",
)
def s5(spark, sf_dir):
    return export_inputs(spark, sf_dir)[2]


@query(
    "s5_exported_series",
    f"""{REQUESTED} SELECT tr.trajectory_id, system_id, CASE WHEN even THEN 'train' ELSE 'test' END
  AS split, count(*) AS frames FROM rq JOIN tr USING (system_id) JOIN ev USING (trajectory_id)
WHERE official GROUP BY ALL""",
)
def s5_frames(spark, sf_dir):
    frames, registry, _ = export_inputs(spark, sf_dir)
    counts = frames.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("frames"))
    return registry.join(counts, "trajectory_id").select(
        "trajectory_id", "system_id", "split", "frames"
    )


@query(
    "s6_channel_projection",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows, sum(l_quantity) AS quantity,
  sum(l_extendedprice) AS price, sum(l_discount) AS discount, sum(l_tax) AS tax
FROM lineitem GROUP BY ALL""".replace("sum(l_extendedprice)", r("sum(l_extendedprice)", 3))
    .replace("sum(l_discount)", r("sum(l_discount)"))
    .replace("sum(l_tax)", r("sum(l_tax)"))
    .replace("sum(l_quantity)", r("sum(l_quantity)")),
)
def s6(spark, sf_dir):
    names = ("quantity", "price", "discount", "tax")
    source = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    keys = ("l_orderkey", "l_linenumber")
    out = ss.project_channels(tb.table(spark, sf_dir, "lineitem"), dict(zip(names, source)), keys)
    digits = {"price": 3}
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[rnd(F.sum(n), digits.get(n, 6)).alias(n) for n in names],
    )


def replicas(spark, sf_dir):
    """Replica frames on a shifted 200 ps axis; some late, some short of a frame."""
    late = F.when(F.col("k") == 99, 1.0).otherwise(0.0)
    frames = tb.event_frames(spark, sf_dir).select(
        "trajectory_id", "frame", (F.col("frame") * 200.0 + 210.0 + late).alias("time"), "value"
    )
    sources = tb.event_trajectories(spark, sf_dir).select(
        "trajectory_id",
        "system_id",
        (F.col("frame_count") + F.when(user() % 10 == 0, 1).otherwise(0)).alias("frame_count"),
        F.lit(200.0).alias("frame_interval_ps"),
    )
    return ss.admit_replicas(frames, sources)


ADMIT = f"""WITH {EVENTS}, tm AS (
  SELECT trajectory_id, frame, value, frame * 200.0::DOUBLE + 210 + CASE WHEN k = 99 THEN 1
    ELSE 0 END AS time FROM ev),
st AS (SELECT *, time - lag(time) OVER (PARTITION BY trajectory_id ORDER BY frame) AS step FROM tm),
ju AS (
  SELECT st.trajectory_id, system_id, n, min(step) = 200 AND max(step) = 200 AS even,
    user_id % 10 = 0 AS short, arg_min(time, frame) AS origin, arg_max(time, frame) AS finish
  FROM st JOIN tr USING (trajectory_id) GROUP BY ALL),
iss AS (
  SELECT trajectory_id, system_id, 'dropped' AS status, CASE WHEN short THEN 'frame count differs'
    ELSE 'spacing differs from the declared interval' END AS reason, 'admission' AS phase
  FROM ju WHERE short OR NOT even)
"""


@query("s7_replica_issues", f"{ADMIT} SELECT trajectory_id, status, reason, phase FROM iss")
def s7_issues(spark, sf_dir):
    return replicas(spark, sf_dir)[2]


@query(
    "s7_replica_admission",
    f"""{ADMIT} SELECT tm.trajectory_id, count(*) AS frames, {r("min(time - origin)")} AS first_time,
  {r("max(time - origin) / 1000")} AS duration_ns, {r("sum(value)", 4)} AS value_sum
FROM tm JOIN ju USING (trajectory_id) WHERE even AND NOT short GROUP BY ALL""",
)
def s7(spark, sf_dir):
    frames, registry, _ = replicas(spark, sf_dir)
    seen = frames.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("time").alias("first_time"),
        F.sum("value").alias("value_sum"),
    )
    return seen.join(registry, "trajectory_id").select(
        "trajectory_id", "frames", rnd("first_time").alias("first_time"),
        rnd("duration_ns").alias("duration_ns"), rnd("value_sum", 4).alias("value_sum"),
    )


@query(
    "s8_group_rejection",
    f"""{ADMIT} SELECT trajectory_id, status, reason, phase FROM iss
UNION ALL SELECT trajectory_id, 'dropped', 'another replica of the group failed', 'group' FROM ju
WHERE system_id IN (SELECT system_id FROM iss)
  AND trajectory_id NOT IN (SELECT trajectory_id FROM iss)
UNION ALL SELECT trajectory_id, 'kept', '', '' FROM ju
WHERE system_id NOT IN (SELECT system_id FROM iss)""",
)
def s8(spark, sf_dir):
    _, _, issues = replicas(spark, sf_dir)
    kept, logged = ss.drop_failed_groups(
        tb.event_trajectories(spark, sf_dir), cut(issues), "system_id"
    )
    rest = kept.select(
        "trajectory_id", F.lit("kept").alias("status"), F.lit("").alias("reason"),
        F.lit("").alias("phase"),
    )
    return logged.unionByName(rest)


@query(
    "s9_feature_set_join",
    f"""WITH {EVENTS} SELECT trajectory_id, frame, frame::DOUBLE AS time, value, k,
  {r("gap_s")} AS gap_s FROM ev""",
)
def s9(spark, sf_dir):
    frames = tb.event_frames_with_gap(spark, sf_dir)
    native = frames.select("trajectory_id", "frame", "time", "value", "k")
    structural = frames.select("trajectory_id", "frame", "time", "gap_s")
    return rounded(ss.join_feature_sets(native, structural), only=["gap_s"])


@query(
    "s10_common_features",
    f"""WITH {EVENTS} SELECT trajectory_id, frame, frame::DOUBLE AS time, value FROM ev""",
)
def s10(spark, sf_dir):
    other = feature_table(spark, "another reading of k")
    return ss.project_common(tb.event_frames(spark, sf_dir), feature_table(spark), other, ["value"])


@query(
    "s11_catalog_scan",
    """WITH c AS (
  SELECT 'A' || event_id AS accession, upper('u' || user_id) AS id, event_id, user_id,
    regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k, event_type FROM events)
SELECT id, min(accession) AS accession FROM c
WHERE event_type <> 'error' AND k % 10 <> 0 AND event_id % 2 = 0 AND user_id % 5 <> 0
GROUP BY id""",
)
def s11(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    owner = F.concat(F.lit("u"), "user_id")
    several = F.get_json_object("props", "$.k").cast("int") % 10 == 0
    licence = F.concat(
        F.lit("Under "),
        F.when(F.col("event_id") % 2 == 0, ss.CATALOG_LICENCE).otherwise("no licence"),
    )
    documents = events.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("A"), "event_id").alias("accession"),
                F.when(F.col("event_type") == "error", 9).otherwise(10).alias("mdcount"),
                F.struct(
                    F.when(several, F.array(owner, owner)).otherwise(F.array(owner)).alias("PDBIDS"),
                    licence.alias("LICENSE"),
                ).alias("metadata"),
            )
        ).alias("value")
    )
    excluded = events.filter(F.col("user_id") % 5 == 0).select(
        F.upper(F.concat(F.lit("u"), "user_id")).alias("id")
    )
    return ss.scan_catalog(documents, excluded)


@query(
    "s12_role_scoped_scan",
    f"""WITH {EVENTS} SELECT trajectory_id, count(*) AS frames, {r("sum(value)", 4)} AS value_sum
FROM ev WHERE user_id // 3 % 4 IN (0, 1) GROUP BY ALL""",
)
def s12(spark, sf_dir):
    registry = tb.event_trajectories(spark, sf_dir)
    block = F.floor(user() / 3) % 4
    role = (
        F.when(block == 0, "train")
        .when(block == 1, "validation")
        .when(block == 2, "calibration")
        .otherwise("confirmation")
    )
    roles = registry.select("system_id", role.alias("role")).distinct()
    allowed = ss.read_for_purpose(
        tb.event_frames(spark, sf_dir), registry, roles, "tuning",
        registry.select(F.col("system_id").alias("id"), "split").distinct(),
    )
    return allowed.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("frames"), rnd(F.sum("value"), 4).alias("value_sum")
    )


@query(
    "s12_pruned_scan",
    f"""WITH {EVENTS} SELECT trajectory_id, count(*) AS frames, {r("sum(value)", 4)} AS value_sum
FROM ev WHERE user_id // 9 % 5 <= 3 GROUP BY ALL""",
)
def s12_pruned(spark, sf_dir):
    """Tuning series from the scoped store: roles follow the official splits."""
    registry = tb.event_trajectories(spark, sf_dir)
    role = F.when(F.col("split") == "test", "confirmation").otherwise(F.col("split"))
    official = registry.select(F.col("system_id").alias("id"), "split").distinct()
    faults = ss.record_faults(registry, registry, "events", None, official)
    allowed = ss.read_scoped(
        spark, tb.scoped_store(spark, sf_dir), ["value", "k"], registry,
        registry.select("system_id", role.alias("role")).distinct(), "tuning", faults,
    )
    return allowed.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("frames"), rnd(F.sum("value"), 4).alias("value_sum")
    )


@query(
    "s12_record_faults",
    f"""WITH {EVENTS} SELECT 'u' || user_id AS trajectory_id, CASE user_id % 7
  WHEN 0 THEN 'unknown record' WHEN 1 THEN 'dataset differs' WHEN 2 THEN 'source differs'
  WHEN 3 THEN 'official split differs' ELSE 'altered record' END AS reason
FROM (SELECT DISTINCT user_id FROM ev) WHERE user_id % 7 < 5""",
)
def s12_faults(spark, sf_dir):
    """Records with one fault each, by the user's number, against the frozen registry."""
    registry = tb.event_trajectories(spark, sf_dir).withColumn("source_checksum", F.lit("bytes"))
    kind = user() % 7
    given = (
        registry.withColumn("dataset_id", F.when(kind == 1, "others").otherwise(F.col("dataset_id")))
        .withColumn("source_checksum", F.when(kind == 2, "changed").otherwise(F.col("source_checksum")))
        .withColumn("split", F.when(kind == 3, "elsewhere").otherwise(F.col("split")))
        .withColumn("frame_count", F.when(kind == 4, F.col("frame_count") + 1).otherwise(F.col("frame_count")))
    )
    official = registry.select(F.col("system_id").alias("id"), "split").distinct()
    return ss.record_faults(given, registry.filter(kind != 0), "events", "bytes", official)


METRICS = f"{fq.LOSSES}, {fq.HIER}"


@query(
    "s13_bundle_round_trip",
    f"""{METRICS}, t AS (
  SELECT 'metrics' AS "table", {CELL}, value AS v FROM metrics
  UNION ALL SELECT 'predictions', {CELL}, point FROM pred
  UNION ALL SELECT 'comparisons', a.context_frames, a.horizon_frames, a.mae - b.mae FROM ag a JOIN ag b
    USING ({CELL}, feature_id, step) WHERE b.model = 'persistence'
  UNION ALL SELECT 'runtime', {CELL}, 0 FROM (SELECT DISTINCT model, {CELL} FROM pred))
SELECT "table", {CELL}, count(*) AS rows, {r("avg(v)", 5)} AS total FROM t GROUP BY ALL""",
)
def s13(spark, sf_dir):
    """Row counts and mean values of the tables read back."""
    total = {
        "metrics": F.avg("value"), "predictions": F.avg("point"), "comparisons": F.avg("mae_difference"),
        "runtime": F.coalesce(F.avg("seconds"), F.lit(0.0)),
    }
    path = scratch(spark)
    bundle.write_bundle(bundle_tables(spark, sf_dir), path)
    stored = bundle.read_bundle(spark, path)
    counted = [
        t.groupBy("context_frames", "horizon_frames")
        .agg(F.count(F.lit(1)).alias("rows"), rnd(total[name], 5).alias("total"))
        .withColumn("table", F.lit(name))
        for name, t in stored.items()
    ]
    return ct.merge(*counted)


def bundle_tables(spark, sf_dir):
    """The four tables of a bundle from the event models.

    Metrics and comparisons come from the stored points of a window; rows per lead are made
    for the predictions table alone.
    """
    sets = fq.point_sets(spark, sf_dir)
    points = mm.each_model(sets)
    scaler = cut(fq.fitted_scaler(spark, sf_dir))
    levels = ls.level_means_of_windows(points, scaler, max(tb.GRID.horizons))
    return {
        "predictions": fc.predictions(mm.each_model(spread(sets))),
        "metrics": ls.hierarchy_of(levels, fq.POLICY),
        "comparisons": fq.inf.compare(ls.metric_of(levels["group"]), "persistence", fq.POLICY),
        "runtime": points.filter(F.size("target") > 0)
        .select("model", "context_frames", "horizon_frames")
        .distinct()
        .withColumn("seconds", F.lit(None).cast("double")),
    }


@query(
    "s13_altered_bundle",
    f"""{METRICS}, n AS (
  SELECT 'predictions' AS "table", (SELECT count(*) FROM pred) AS rows, true AS intact
  UNION ALL SELECT 'metrics', (SELECT count(*) FROM metrics), false
  UNION ALL SELECT 'comparisons', (SELECT count(*) FROM ag), true
  UNION ALL SELECT 'runtime', (SELECT count(*) FROM (SELECT DISTINCT model, {CELL} FROM pred)), true)
SELECT * FROM n""",
)
def s13_altered(spark, sf_dir):
    """A bundle whose metric table has one value changed after its fingerprint was taken.

    The file that holds the value is written anew beside itself, with the change, and removed.
    """
    path = scratch(spark)
    bundle.write_bundle(bundle_tables(spark, sf_dir), path)
    kept = spark.read.parquet(f"{path}/metrics")
    series = ["model", "feature_id", "step", "metric", "horizon_frames"]
    first = kept.filter("level = 'aggregate'").agg(F.min(F.struct(*series)).alias("m")).first()["m"]
    one = F.col("level") == "aggregate"
    for name in series:
        one = one & (F.col(name) == F.lit(first[name]))
    (file,) = [unquote(r[0]) for r in kept.filter(one).select("_metadata.file_path").collect()]
    rows = spark.read.option("basePath", f"{path}/metrics").parquet(file)
    changed = rows.withColumn("value", F.when(one, F.col("value") + 1.0).otherwise(F.col("value")))
    changed.drop("context_frames", "horizon_frames").write.mode("append").parquet(file.rpartition("/")[0])
    delete(spark, file)
    return bundle.check_bundle(spark, path)


@query(
    "s18_aggregate_metrics",
    f"""{METRICS} SELECT model, {CELL}, feature_id, step::INTEGER AS step, metric,
  {r("value")} AS value FROM metrics WHERE level = 'aggregate'""",
)
def s18(spark, sf_dir):
    path = scratch(spark)
    ls.hierarchy(fq.scored(spark, sf_dir)).write.parquet(path)
    out = bundle.read_metrics(spark, path)
    return rounded(out.drop("level", "identity", "lower_q", "upper_q"))


@query(
    "s15_manifest_check",
    """SELECT s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'digest differs'
  WHEN 1 THEN 'size differs' ELSE 'unlisted' END AS reason
FROM supplier WHERE s_suppkey % 5 < 3
UNION ALL SELECT 'NOWHERE', 'missing'""",
)
def s15_check(spark, sf_dir):
    """Files of known text, one a supplier, against a manifest with faults by rule.

    Files over 82 bytes are streamed, so both ways of reading meet the same manifest.
    """
    rows = tb.table(spark, sf_dir, "supplier")
    line = F.to_json(F.struct(*sorted(rows.columns)))
    folder = scratch(spark)
    known = rows.select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), line.alias("value"))
    bundle.write_files(known, folder)
    digests = bundle.file_digests(spark, folder, "*.txt", bundle.file_name, 82)
    text, rule = F.concat("value", F.lit("\n")), F.col("number") % 5
    size = F.octet_length(text).cast("long")
    manifest = known.filter(rule != 2).select(
        "name",
        F.when(rule == 1, size + 1).otherwise(size).alias("size"),
        F.when(rule == 3, "md5").otherwise("sha256").alias("algorithm"),
        F.when(rule == 0, F.sha2(F.lit("another text"), 256))
        .when(rule == 3, F.md5(text))
        .otherwise(F.sha2(text, 256))
        .alias("digest"),
    )
    lost = spark.range(1).select(
        F.lit("NOWHERE").alias("name"), F.lit(1).cast("long").alias("size"),
        F.lit("md5").alias("algorithm"), F.md5(F.lit("")).alias("digest"),
    )
    return bundle.verify_files(digests, manifest.unionByName(lost))


@query("s15_file_digests")
def s15(spark, sf_dir):
    return bundle.file_digests(spark, sf_dir, "*.parquet")


@query(
    "s16_table_fingerprint",
    """WITH h AS (SELECT sha256('{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey
  || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":'
  || c_nationkey || '}') AS h FROM customer),
l AS (SELECT i, sum(('0x' || substr(h, 8 * i + 1, 8))::BIGINT)::VARCHAR AS s
  FROM h, range(8) t(i) GROUP BY i)
SELECT (SELECT count(*) FROM h) AS rows,
  sha256((SELECT count(*) FROM h) || '|' || string_agg(s, '|' ORDER BY i)) AS fingerprint FROM l""",
)
def s16(spark, sf_dir):
    return fingerprint_frame(tb.table(spark, sf_dir, "customer"))


@query(
    "s19_identity_keys",
    """WITH s AS (SELECT *, 'shop:system:' || url_encode(c_name) AS system_id FROM customer)
SELECT c_custkey, system_id, 'trajectory:' || url_encode(system_id) || ':'
  || url_encode(c_mktsegment || ' /' || c_nationkey) || ':' || c_nationkey AS trajectory_id FROM s""",
)
def s19(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lit("shop").alias("dataset_id"),
        F.col("c_name").alias("source_system"),
        F.concat("c_mktsegment", F.lit(" /"), "c_nationkey").alias("source_trajectory"),
        F.col("c_nationkey").cast("string").alias("replicate_id"),
    )
    return ss.with_ids(rows).select("c_custkey", "system_id", "trajectory_id")


COHORT = """WITH o AS (
  SELECT c_custkey AS id, c_acctbal < 0 AS bad, CASE WHEN c_custkey % 10 <= 6 THEN 'train'
    WHEN c_custkey % 10 <= 8 THEN 'validation' ELSE 'test' END AS split FROM customer),
el AS (SELECT id, split FROM o WHERE NOT bad AND id IN (SELECT o_custkey FROM orders)),
rk AS (SELECT *, row_number() OVER (PARTITION BY split
  ORDER BY sha256('42|' || split || '|' || id), id) - 1 AS rank FROM el),
co AS (
  SELECT id, split, rank, CASE WHEN split = 'train' AND rank < 40 THEN 'train'
    WHEN split = 'validation' AND rank < 8 THEN 'validation'
    WHEN split = 'validation' AND rank < 14 THEN 'calibration'
    WHEN split = 'test' AND rank < 5 THEN 'confirmation' END AS role FROM rk)
"""


def cohort(spark, sf_dir):
    return ch.select_cohort(*tb.customers(spark, sf_dir), COUNTS, 42)


@query("c6_cohort_selection", f"{COHORT} SELECT id, split, role, rank FROM co WHERE role IS NOT NULL")
def c6(spark, sf_dir):
    return cohort(spark, sf_dir)


@query("c7_eligible_counts", f"{COHORT} SELECT split, count(*) AS eligible FROM el GROUP BY split")
def c7(spark, sf_dir):
    return ch.eligible_counts(*tb.customers(spark, sf_dir))


ROLES = {"train": (1, 2, 3), "validation": (4, 5), "calibration": (6,), "confirmation": (7, 8, 9, 10)}


@query(
    "c8_reserve_roles",
    """WITH r AS (SELECT c_custkey AS id,
    row_number() OVER (ORDER BY sha256('42|unseen|' || c_custkey), c_custkey) - 1 AS rank
  FROM customer),
s AS (SELECT *, CASE WHEN rank < 20 THEN 'confirmation' WHEN rank < 30 THEN 'seen-replica'
  WHEN rank < 45 THEN 'extension' END AS slice FROM r WHERE rank < 45)
SELECT id, rank, slice, n::INTEGER AS replica, CASE WHEN slice <> 'seen-replica' OR n > 6
  THEN 'confirmation' WHEN n <= 3 THEN 'train' WHEN n <= 5 THEN 'validation'
  ELSE 'calibration' END AS role FROM s, range(1, 11) t(n)""",
)
def c8(spark, sf_dir):
    ids = tb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return ch.reserve_roles(ids, (20, 10, 15), ROLES, 42)


LINES = """WITH d AS (
  SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, lang FROM documents),
b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark),
k AS (SELECT DISTINCT lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
f AS (SELECT id, bool_or(line IN (SELECT line FROM b)) AS lines_shared,
  bool_or(lang IN (SELECT lang FROM k)) AS keys_shared FROM d GROUP BY id)
"""


def audit(spark, sf_dir):
    documents = tb.table(spark, sf_dir, "documents")
    benchmark = tb.table(spark, sf_dir, "benchmark")
    labels = tb.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    a = documents.select(
        F.col("doc_id").alias("id"),
        F.split("text", "\n").alias("lines"),
        F.array("lang").alias("keys"),
    )
    toxic = documents.join(labels, "doc_id", "left_semi")
    b = benchmark.select(
        F.split("text", "\n").alias("lines"), F.array().cast("array<string>").alias("keys")
    ).unionByName(
        toxic.select(
            F.array().cast("array<string>").alias("lines"), F.array("lang").alias("keys")
        )
    )
    return ch.overlap_audit(a, b, ["lines", "keys"])


@query("c10_overlap_audit", f"{LINES} SELECT * FROM f")
def c10(spark, sf_dir):
    return audit(spark, sf_dir)


@query(
    "c10_overlap_counts",
    f"""{LINES} SELECT count(*) AS audited, count_if(lines_shared)::BIGINT AS lines_shared,
  count_if(keys_shared)::BIGINT AS keys_shared FROM f""",
)
def c10_counts(spark, sf_dir):
    return ch.overlap_counts(audit(spark, sf_dir))


@query(
    "v11_transfer_guard",
    """WITH a AS (SELECT DISTINCT s_nationkey AS e FROM supplier),
b AS (SELECT DISTINCT c_nationkey AS e FROM customer),
v AS (
  SELECT 'shared-entity' AS rule FROM a JOIN b USING (e)
  UNION ALL SELECT 'fitted-only' UNION ALL SELECT 'target-only')
SELECT rule, count(*) AS violations FROM v GROUP BY rule""",
)
def v11(spark, sf_dir):
    def entities(table, column):
        return table.select(F.col(column).cast("string").alias("entity_id"))

    fitted = feature_table(spark).withColumn("feature_set_version", F.lit("1"))
    target = feature_table(spark, "other").withColumn("feature_set_version", F.lit("1"))
    customers = tb.table(spark, sf_dir, "customer")
    return ct.counted(
        ct.check_transfer(
            fitted, target,
            entities(tb.table(spark, sf_dir, "supplier"), "s_nationkey"),
            entities(customers, "c_nationkey"),
        )
    )


@query(
    "v13_cohort_contract",
    f"""{COHORT}, al AS (
  SELECT id, CASE WHEN id % 9 = 0 THEN 'train' ELSE role END AS role FROM co WHERE role IS NOT NULL
  UNION ALL SELECT id, 'train' FROM o WHERE bad),
v AS (
  SELECT 'excluded' AS rule, count(*) AS n FROM al JOIN o USING (id) WHERE bad
  UNION ALL SELECT 'official-split', count(*) FROM al JOIN o USING (id) WHERE split
    <> CASE role WHEN 'train' THEN 'train' WHEN 'confirmation' THEN 'test' ELSE 'validation' END
  UNION ALL SELECT 'role-count', count(*) FROM (SELECT role, count(*) AS n FROM al GROUP BY role)
    WHERE n <> CASE role WHEN 'train' THEN 40 WHEN 'validation' THEN 8 WHEN 'calibration' THEN 6
      ELSE 5 END)
SELECT rule, n AS violations FROM v WHERE n > 0""",
)
def v13(spark, sf_dir):
    official, _, excluded = tb.customers(spark, sf_dir)
    roles = cohort(spark, sf_dir).select(
        "id", F.when(F.col("id") % 9 == 0, "train").otherwise(F.col("role")).alias("role")
    )
    altered = roles.unionByName(excluded.select("id", F.lit("train").alias("role")))
    return ct.counted(ct.validate_cohort(altered, official, excluded, COUNTS))
