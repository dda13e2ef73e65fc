"""Queries over splits, windows, scaling and their contracts."""

from pyspark.sql import functions as F

from rollspan.operators import contracts as ct
from rollspan.operators import scaling as sc
from rollspan.operators import splits as sp
from rollspan.operators import windows as wn
from rollspan.operators.series import long_frames
from rollspan.plans import sql
from rollspan.plans import testbed as tb
from rollspan.plans.registry import query, rnd, rounded
from rollspan.plans.sql import CTX, EVENTS, GRIDS, KEY, REGIONS, SCALER, r

WIN = f"WITH {EVENTS}, {sql.win(GRIDS[EVENTS])}"
PS_GRID = wn.Grid(contexts=(160, 400), horizons=(160, 800), stride=5, unit="ps")
SPARSE = wn.Grid(contexts=(3, 20), horizons=(2,), stride=7)
WIDE = wn.Grid(contexts=(20, 40), horizons=(5, 10, 20), stride=5)


def physical_users(spark, sf_dir):
    """The users' registry with physical axes of mixed quality."""
    u = F.substring("trajectory_id", 2, 20).cast("long")
    interval = F.when(u % 3 == 0, 80.0).when(u % 3 == 1, 100.0)
    frames = F.when(u % 4 == 3, F.col("frame_count")).otherwise(F.col("frame_count") - 1)
    return (
        tb.event_trajectories(spark, sf_dir)
        .withColumn("time_unit", F.when(u % 5 == 4, "frame").otherwise("ps"))
        .withColumn("frame_interval_ps", interval)
        .withColumn("sampling_status", F.when(u % 2 == 0, "verified").otherwise("assumed"))
        .withColumn("sampling_note", F.when(u % 7 == 1, "from the file header"))
        .withColumn("duration_ns", frames * F.coalesce(interval, F.lit(50.0)) / 1000)
    )


PHYSICAL = f"""{EVENTS},
ph AS (
  SELECT *, CASE WHEN user_id % 5 = 4 THEN 'frame' ELSE 'ps' END AS time_unit,
    CASE WHEN user_id % 3 = 0 THEN 80.0::DOUBLE WHEN user_id % 3 = 1 THEN 100 END AS dt,
    CASE WHEN user_id % 2 = 0 THEN 'verified' ELSE 'assumed' END AS sampling_status,
    CASE WHEN user_id % 7 = 1 THEN 'x' END AS note,
    (CASE WHEN user_id % 4 = 3 THEN n ELSE n - 1 END)
      * coalesce(CASE WHEN user_id % 3 = 0 THEN 80.0::DOUBLE WHEN user_id % 3 = 1 THEN 100 END,
        50) / 1000 AS duration_ns
  FROM tr)
"""


@query(
    "w1_resolve_grid",
    f"""WITH {PHYSICAL},
g(context, horizon) AS (VALUES (160, 160), (160, 800), (400, 160), (400, 800)),
x AS (
  SELECT trajectory_id, context::DOUBLE AS context, horizon::DOUBLE AS horizon,
    round_even(context / dt, 0) AS cs, round_even(horizon / dt, 0) AS hs, n, dt,
    sampling_status, context / dt AS c, horizon / dt AS h
  FROM ph, g)
SELECT trajectory_id, context, horizon, coalesce((cs + 1)::INTEGER, -1) AS context_frames,
  coalesce(hs::INTEGER, -1) AS horizon_frames,
  CASE WHEN dt IS NULL THEN 'no uniform interval'
    WHEN sampling_status <> 'verified' THEN 'time is not verified'
    WHEN abs(c - cs) > 1e-9 * greatest(c, cs) OR abs(h - hs) > 1e-9 * greatest(h, hs)
      THEN 'not aligned to the interval'
    WHEN hs < 1 OR cs + 1 + hs > n THEN 'longer than the series' END AS reason
FROM x""",
)
def w1(spark, sf_dir):
    return wn.resolve_grid(physical_users(spark, sf_dir), PS_GRID).select(
        "trajectory_id", "context", "horizon", *frame_lengths(), "reason"
    )


def frame_lengths():
    """Resolved lengths with -1 for the cells that have none."""
    return [F.coalesce(c, F.lit(-1)).alias(c) for c in ("context_frames", "horizon_frames")]


@query(
    "w2_windows",
    f"{WIN} SELECT trajectory_id, start, context_frames, horizon_frames, system_id, group_id, "
    "split FROM win",
)
def w2(spark, sf_dir):
    return tb.event_windows(spark, sf_dir).select(
        *wn.WINDOW_KEY, "system_id", "group_id", "split"
    )


@query(
    "w3_feasibility",
    f"""WITH {EVENTS},
g(c, h) AS (VALUES (20, 5), (20, 10), (20, 20), (40, 5), (40, 10), (40, 20))
SELECT trajectory_id, c::DOUBLE AS context, h::DOUBLE AS horizon,
  CASE WHEN c + h <= n THEN c ELSE -1 END AS context_frames,
  CASE WHEN c + h <= n THEN h ELSE -1 END AS horizon_frames,
  CASE WHEN c + h <= n THEN (n - c - h) // 5 + 1 ELSE 0 END AS window_count,
  CASE WHEN c + h > n THEN 'longer than the series' END AS reason
FROM tr, g""",
)
def w3(spark, sf_dir):
    return wn.feasibility(tb.event_trajectories(spark, sf_dir), WIDE).select(
        "trajectory_id", "context", "horizon", *frame_lengths(), "window_count", "reason"
    )


ISLANDS = """
iv AS (SELECT DISTINCT trajectory_id, start, start + context_frames AS stop FROM win),
fl AS (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY trajectory_id
    ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS fresh FROM iv),
isl AS (
  SELECT *, sum(fresh) OVER (PARTITION BY trajectory_id ORDER BY start, stop) AS island FROM fl),
reg AS (
  SELECT trajectory_id, min(start) AS start, max(stop) AS stop FROM isl
  GROUP BY trajectory_id, island)
"""


@query(
    "w4_context_regions",
    f"""WITH {EVENTS}, {sql.win(((3,), (2,), 7))}, {ISLANDS}
SELECT * FROM reg""",
)
def w4(spark, sf_dir):
    grid = wn.Grid(contexts=(3,), horizons=(2,), stride=7)
    return wn.context_regions(tb.event_windows(spark, sf_dir, grid=grid))


@query(
    "w4_context_regions_mixed_grid",
    f"""WITH {EVENTS}, {sql.win(((3, 20), (2,), 7), "train")}, {ISLANDS}
SELECT * FROM reg""",
)
def w4_mixed(spark, sf_dir):
    return wn.context_regions(tb.event_windows(spark, sf_dir, "train", SPARSE))


def weighted(name):
    """Order-sensitive digest of an array: sum of value times position."""
    return F.aggregate(
        F.transform(name, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )


ARRAY_SQL = f"""{CTX},
c AS (SELECT {KEY}, feature_id, sum(x * (i + 1)) AS c, count(*) AS nc FROM ctx GROUP BY ALL),
t AS (SELECT {KEY}, feature_id, sum(target * step) AS t, count(*) AS nt FROM tgt GROUP BY ALL)
"""


@query(
    "w5_window_arrays",
    f"""{WIN}, {ARRAY_SQL}
SELECT {KEY}, feature_id, nc::INTEGER AS context_size, nt::INTEGER AS target_size,
  {r("c", 4)} AS context_sum, {r("t", 4)} AS target_sum
FROM c JOIN t USING ({KEY}, feature_id)""",
)
def w5(spark, sf_dir):
    arrays = tb.event_arrays(spark, sf_dir)
    return arrays.select(
        *wn.WINDOW_KEY, "feature_id",
        F.size("context").alias("context_size"),
        F.size("target").alias("target_size"),
        rnd(weighted("context"), 4).alias("context_sum"),
        rnd(weighted("target"), 4).alias("target_sum"),
    )


@query(
    "w6_first_windows",
    f"""{WIN}, o AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id
  ORDER BY start, context_frames, horizon_frames) AS rn FROM win)
SELECT {KEY}, group_id FROM o WHERE rn = 1""",
)
def w6(spark, sf_dir):
    cells, _ = wn.admit(tb.event_trajectories(spark, sf_dir), tb.event_assignments(spark, sf_dir), tb.GRID)
    return wn.first_windows(cells).select(*wn.WINDOW_KEY, "group_id")


@query(
    "w7_training_inventory",
    f"""{WIN}
SELECT split, count(*) AS windows, count(DISTINCT trajectory_id) AS trajectories,
  2 * count(*) AS rows FROM win WHERE split <> 'test' GROUP BY split""",
)
def w7(spark, sf_dir):
    exported = wn.export_training(tb.event_arrays(spark, sf_dir))
    return wn.training_inventory(exported).drop("fingerprint")


@query(
    "w7_training_export",
    f"""{WIN}, {CTX},
a AS (SELECT split, {KEY}, feature_id, x, i + 1 AS p FROM ctx
  UNION ALL SELECT split, {KEY}, feature_id, target, context_frames + step FROM tgt)
SELECT split, {KEY}, feature_id, count(*)::INTEGER AS length, {r("sum(x * p)", 4)} AS series_sum
FROM a WHERE split <> 'test' GROUP BY ALL""",
)
def w7_rows(spark, sf_dir):
    exported = wn.export_training(tb.event_arrays(spark, sf_dir))
    return exported.select(
        "split", *wn.WINDOW_KEY, "feature_id",
        F.size("series").alias("length"),
        rnd(weighted("series"), 4).alias("series_sum"),
    )


@query(
    "w8_shifted_condition",
    f"""{WIN}, {CTX}
SELECT {KEY}, feature_id,
  {r("sum(x * (CASE WHEN feature_id = 'value' THEN i ELSE (i + 7) % context_frames END + 1))", 4)}
    AS context_sum
FROM ctx GROUP BY ALL""",
)
def w8(spark, sf_dir):
    shifted = wn.input_condition(tb.event_arrays(spark, sf_dir), "value", "shifted", 7)
    return shifted.select(
        *wn.WINDOW_KEY, "feature_id", rnd(weighted("context"), 4).alias("context_sum")
    )


@query(
    "w8_target_only",
    f"""{WIN}, {CTX}
SELECT {KEY}, feature_id, {r("sum(x * (i + 1))", 4)} AS context_sum
FROM ctx WHERE feature_id = 'value' GROUP BY ALL""",
)
def w8_target(spark, sf_dir):
    only = wn.input_condition(tb.event_arrays(spark, sf_dir), "value", "target-only")
    return only.select(
        *wn.WINDOW_KEY, "feature_id", rnd(weighted("context"), 4).alias("context_sum")
    )


@query(
    "w9_exposure",
    f"""{WIN}, d AS (
  SELECT w.*, (user_id + start // 5) % 3 AS n FROM win w JOIN tr USING (trajectory_id)
  WHERE w.split = 'train')
SELECT sum(n)::BIGINT AS draws, count_if(n > 0)::BIGINT AS windows_seen, count(*) AS windows,
  count(DISTINCT CASE WHEN n > 0 THEN trajectory_id END) AS trajectories_seen,
  count(DISTINCT CASE WHEN n > 0 THEN system_id END) AS systems_seen
FROM d""",
)
def w9(spark, sf_dir):
    index = tb.event_windows(spark, sf_dir)
    u = F.substring("trajectory_id", 2, 20).cast("long")
    log = index.select(*wn.WINDOW_KEY, ((u + F.floor(F.col("start") / 5)) % 3).alias("draws"))
    return wn.exposure(log, index)


@query(
    "e1_fit_scaler",
    f"""{WIN}, {SCALER}
SELECT feature_id, {r("center")} AS center, {r("scale")} AS scale, sample_count FROM scaler""",
)
def e1(spark, sf_dir):
    return rounded(fitted_scaler(spark, sf_dir))


def fitted_scaler(spark, sf_dir, source="event"):
    """TRAIN-context scaler of a testbed source."""
    events = source == "event"
    index = (tb.event_windows if events else tb.month_windows)(spark, sf_dir, "train")
    frames = (tb.event_frames if events else tb.month_frames)(spark, sf_dir)
    features = tb.EVENT_FEATURES if events else tb.MONTH_FEATURES
    return sc.fit_scaler(frames, wn.context_regions(index), features)


@query(
    "e2_context_scaler",
    f"""{WIN}, {CTX}
SELECT {KEY}, feature_id, {r("avg(x)")} AS center,
  {r("CASE WHEN min(x) = max(x) THEN 1 ELSE stddev_pop(x) END")} AS scale
FROM ctx GROUP BY ALL""",
)
def e2(spark, sf_dir):
    fitted = sc.fit_context_scaler(tb.event_arrays(spark, sf_dir))
    return rounded(fitted.select(*wn.WINDOW_KEY, "feature_id", "center", "scale"))


@query(
    "e3_scale",
    f"""{WIN}, {SCALER}
SELECT trajectory_id, frame, feature_id, {r("(x - center) / scale")} AS value,
  {r("x")} AS restored
FROM lf JOIN scaler USING (feature_id)""",
)
def e3(spark, sf_dir):
    scaler = fitted_scaler(spark, sf_dir)
    rows = long_frames(tb.event_frames(spark, sf_dir), tb.EVENT_FEATURES)
    scaled = sc.scale(rows, scaler).withColumn("restored", F.col("value"))
    back = sc.scale(scaled, scaler, ("restored",), inverse=True)
    return rounded(back.select("trajectory_id", "frame", "feature_id", "value", "restored"))


COMPONENTS = f"""WITH RECURSIVE {EVENTS},
rel AS (
  SELECT trajectory_id, 'system|' || system_id AS k FROM tr
  UNION ALL SELECT trajectory_id, 'source|' || split_group_id FROM tr
  UNION ALL SELECT trajectory_id, 'label|' || label FROM tr),
hop AS (
  SELECT DISTINCT a.trajectory_id AS a, b.trajectory_id AS b FROM rel a JOIN rel b USING (k)),
reach(a, b) AS (
  SELECT a, b FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b),
comp AS (SELECT a AS trajectory_id, min(b) AS group_id FROM reach GROUP BY a)
"""


def event_components(spark, sf_dir):
    return sp.components(tb.event_trajectories(spark, sf_dir), tb.event_labels(spark, sf_dir))


@query("c1_components", f"{COMPONENTS} SELECT * FROM comp")
def c1(spark, sf_dir):
    return event_components(spark, sf_dir)


@query("c2_labels", f"WITH {EVENTS} SELECT trajectory_id, split_group_id AS label FROM tr")
def c2(spark, sf_dir):
    return sp.resolve_labels(tb.event_trajectories(spark, sf_dir), field="split_group_id")


@query("c2_label_mapping", f"WITH {EVENTS} SELECT trajectory_id, label FROM tr")
def c2_mapping(spark, sf_dir):
    return sp.resolve_labels(
        tb.event_trajectories(spark, sf_dir), mapping=tb.event_labels(spark, sf_dir)
    )


@query(
    "c3_official_split",
    f"{COMPONENTS} SELECT trajectory_id, comp.group_id, split FROM comp JOIN tr USING (trajectory_id)",
)
def c3(spark, sf_dir):
    return sp.official_split(
        tb.event_trajectories(spark, sf_dir), event_components(spark, sf_dir)
    )


@query(
    "c4_grouped_split",
    f"""WITH {EVENTS},
ks AS (SELECT DISTINCT split_group_id AS group_id FROM tr),
rk AS (SELECT group_id, row_number() OVER (ORDER BY sha256('7|' || group_id), group_id) - 1 AS rank,
  count(*) OVER () AS n FROM ks),
q AS (SELECT *, floor(n * 0.5::DOUBLE) AS a, floor(n * 0.3::DOUBLE) AS b,
  floor(n * 0.2::DOUBLE) AS c FROM rk),
f AS (SELECT *, n * 0.5::DOUBLE - a AS ra, n * 0.3::DOUBLE - b AS rb, n * 0.2::DOUBLE - c AS rc,
  n - a - b - c AS spare FROM q),
o AS (SELECT *,
  a + CASE WHEN 1 + (rb > ra)::INT + (rc > ra)::INT <= spare THEN 1 ELSE 0 END AS ta,
  b + CASE WHEN 1 + (ra >= rb)::INT + (rc > rb)::INT <= spare THEN 1 ELSE 0 END AS tb FROM f)
SELECT tr.trajectory_id, o.group_id,
  CASE WHEN rank < ta THEN 'train' WHEN rank < ta + tb THEN 'validation' ELSE 'test' END AS split
FROM tr JOIN o ON o.group_id = tr.split_group_id""",
)
def c4(spark, sf_dir):
    groups = tb.event_trajectories(spark, sf_dir).select(
        "trajectory_id", F.col("split_group_id").alias("group_id")
    )
    return sp.grouped_split(groups, (0.5, 0.3, 0.2), 7)


@query(
    "c5_replica_split",
    f"""WITH {EVENTS}
SELECT trajectory_id, system_id AS group_id,
  CASE WHEN replicate_id = '3' THEN 'test' ELSE 'train' END AS split FROM tr""",
)
def c5(spark, sf_dir):
    rows = tb.event_trajectories(spark, sf_dir).withColumn(
        "split", F.lit(None).cast("string")
    )
    groups = rows.select("trajectory_id", F.col("system_id").alias("group_id"))
    return sp.replica_split(rows, groups, {"1": "train", "2": "train", "3": "test"})


@query(
    "c9_development_subset",
    f"""WITH {EVENTS}, g AS (
  SELECT group_id, row_number() OVER (ORDER BY sha256('11|' || group_id), group_id) AS rn
  FROM (SELECT DISTINCT group_id FROM tr WHERE split = 'train'))
SELECT trajectory_id, group_id, split FROM tr JOIN g USING (group_id)
WHERE split = 'train' AND rn <= 5""",
)
def c9(spark, sf_dir):
    return sp.select_development(tb.event_assignments(spark, sf_dir), 5, 11)


def physical_frames(spark, sf_dir):
    """Event frames on the physical axes above; every fortieth event is one tick late."""
    users = physical_users(spark, sf_dir).select("trajectory_id", "frame_interval_ps")
    late = F.when(F.col("k") > 97, 1.0).otherwise(0.0)
    step = F.coalesce("frame_interval_ps", F.lit(50.0))
    return (
        tb.event_frames(spark, sf_dir)
        .join(users, "trajectory_id")
        .select(
            "trajectory_id", "frame",
            (F.col("frame") * step + F.when(F.col("frame") > 0, late).otherwise(0.0)).alias("time"),
            F.when(F.col("value") < 0.5, float("nan")).otherwise(F.col("value")).alias("value"),
            "k",
        )
    )


V1_SQL = f"""WITH {PHYSICAL},
pf AS (
  SELECT e.trajectory_id, frame, k, value < 0.5 AS bad, n, dt, time_unit, duration_ns,
    frame * coalesce(dt, 50) + CASE WHEN frame > 0 AND k > 97 THEN 1 ELSE 0 END AS time
  FROM ev e JOIN ph USING (trajectory_id)),
st AS (
  SELECT *, time - lag(time) OVER (PARTITION BY trajectory_id ORDER BY frame) AS step FROM pf),
ag AS (
  SELECT trajectory_id, any_value(time_unit) AS time_unit, any_value(duration_ns) AS d,
    count_if(bad) AS unfit, count_if(step <= 0) AS backward, count_if(time <> frame) AS off_axis,
    count_if(abs(step - dt) > 1e-10 + 1e-9 * dt) AS uneven, arg_max(time, frame) / 1000 AS ns
  FROM st GROUP BY trajectory_id),
v AS (
  SELECT 'finite' AS rule, unfit > 0 AS bad FROM ag
  UNION ALL SELECT 'time-order', backward > 0 FROM ag
  UNION ALL SELECT 'frame-axis', time_unit = 'frame' AND off_axis > 0 FROM ag
  UNION ALL SELECT 'duration', time_unit <> 'frame' AND abs(ns - d) > 1e-10 + 1e-9 * d FROM ag
  UNION ALL SELECT 'interval', time_unit <> 'frame' AND uneven > 0 FROM ag)
SELECT rule, count(*) AS violations FROM v WHERE bad GROUP BY rule"""


@query("v1_series_contract", V1_SQL)
def v1(spark, sf_dir):
    return ct.counted(
        ct.validate_frames(
            physical_frames(spark, sf_dir), physical_users(spark, sf_dir), tb.EVENT_FEATURES
        )
    )


@query(
    "v2_registry_contract",
    f"""WITH {EVENTS}, m AS (
  SELECT s.system_id, count(DISTINCT user_id % 2) AS n FROM tr s GROUP BY system_id),
g AS (SELECT split_group_id, count(DISTINCT CASE WHEN user_id % 11 = 0 THEN 'test' ELSE split END)
  AS n FROM tr GROUP BY split_group_id)
SELECT 'system-identity' AS rule, count(*) AS violations FROM m WHERE n > 1
  HAVING count(*) > 0
UNION ALL SELECT 'group-crosses-splits', count(*) FROM g WHERE n > 1 HAVING count(*) > 0""",
)
def v2(spark, sf_dir):
    u = F.substring("trajectory_id", 2, 20).cast("long")
    altered = (
        tb.event_trajectories(spark, sf_dir)
        .withColumn("protein_id", (u % 2).cast("string"))
        .withColumn("split", F.when(u % 11 == 0, "test").otherwise(F.col("split")))
    )
    return ct.counted(ct.validate_registry(altered))


@query(
    "v3_time_axis",
    f"""WITH {PHYSICAL}, v AS (
  SELECT 'frame-axis-claims-time' AS rule, time_unit = 'frame' AS bad FROM ph
  UNION ALL SELECT 'assumed-without-note',
    time_unit <> 'frame' AND sampling_status = 'assumed' AND note IS NULL FROM ph
  UNION ALL SELECT 'duration-differs', time_unit <> 'frame' AND dt IS NOT NULL
    AND user_id % 4 = 3 FROM ph)
SELECT rule, count(*) AS violations FROM v WHERE bad GROUP BY rule""",
)
def v3(spark, sf_dir):
    return ct.counted(ct.validate_time_axis(physical_users(spark, sf_dir)))


@query(
    "v4_observed_intervals",
    f"""WITH {PHYSICAL}, {sql.win(((3,), (2,), 7))}, {ISLANDS},
pf AS (
  SELECT e.trajectory_id, frame, value < 0.5 AS bad, dt, time_unit,
    frame * coalesce(dt, 50) + CASE WHEN frame > 0 AND k > 97 THEN 1 ELSE 0 END AS time
  FROM ev e JOIN ph USING (trajectory_id)),
st AS (
  SELECT *, time - lag(time) OVER (PARTITION BY trajectory_id ORDER BY frame) AS step FROM pf),
o AS (SELECT st.* FROM st JOIN reg ON reg.trajectory_id = st.trajectory_id
  AND frame >= reg.start AND frame < reg.stop),
v AS (
  SELECT 'finite' AS rule, bad FROM o
  UNION ALL SELECT 'time-order', step <= 0 FROM o
  UNION ALL SELECT 'frame-axis', time_unit = 'frame' AND time <> frame FROM o
  UNION ALL SELECT 'interval', time_unit <> 'frame'
    AND abs(time - frame * dt) > 1e-10 + 1e-9 * frame * dt FROM o)
SELECT rule, count(*) AS violations FROM v WHERE bad GROUP BY rule""",
)
def v4(spark, sf_dir):
    grid = wn.Grid(contexts=(3,), horizons=(2,), stride=7)
    regions = wn.context_regions(tb.event_windows(spark, sf_dir, grid=grid))
    return ct.counted(
        ct.validate_observed(
            physical_frames(spark, sf_dir), regions, physical_users(spark, sf_dir),
            tb.EVENT_FEATURES,
        )
    )


@query(
    "v5_window_contract",
    f"""{WIN}, g AS (
  SELECT w.*, user_id, n, start + CASE WHEN user_id % 4 = 1 THEN 1 WHEN user_id % 4 = 2 THEN 50
    ELSE 0 END AS s FROM win w JOIN tr USING (trajectory_id)),
v AS (
  SELECT 'stride' AS rule, s % 5 <> 0 AS bad FROM g
  UNION ALL SELECT 'bounds', s + context_frames + horizon_frames > n FROM g
  UNION ALL SELECT 'identity', user_id % 4 = 3 FROM g)
SELECT rule, count(*) AS violations FROM v WHERE bad GROUP BY rule""",
)
def v5(spark, sf_dir):
    u = F.substring("trajectory_id", 2, 20).cast("long")
    moved = F.when(u % 4 == 1, 1).when(u % 4 == 2, 50).otherwise(0)
    given = (
        tb.event_windows(spark, sf_dir)
        .withColumn("start", F.col("start") + moved)
        .withColumn("split", F.when(u % 4 == 3, "other").otherwise(F.col("split")))
    )
    return ct.counted(
        ct.validate_windows(
            given, tb.event_trajectories(spark, sf_dir), tb.event_assignments(spark, sf_dir),
            tb.GRID,
        )
    )


@query(
    "v12_scaler_scope",
    f"""WITH {EVENTS}, {sql.win(((3, 20), (2,), 7), "train")}, {ISLANDS},
fit AS (SELECT trajectory_id, start, stop + CASE WHEN stop % 3 = 0 THEN 6 ELSE 0 END AS stop
  FROM reg),
lagged AS (SELECT *, max(stop) OVER (PARTITION BY trajectory_id ORDER BY start, stop
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fit),
v AS (
  SELECT 'undeclared-region' AS rule, count(*) AS violations
    FROM (FROM fit EXCEPT ALL FROM reg)
  UNION ALL SELECT 'missing-region', count(*) FROM (FROM reg EXCEPT ALL FROM fit)
  UNION ALL SELECT 'overlap', count(*) FROM lagged WHERE before > start
  UNION ALL SELECT 'sample-count', CASE WHEN (SELECT sum(stop - start) FROM fit)
    <> (SELECT sum(stop - start) FROM reg) THEN 2 ELSE 0 END)
SELECT rule, violations::BIGINT AS violations FROM v WHERE violations > 0""",
)
def v12(spark, sf_dir):
    declared = wn.context_regions(tb.event_windows(spark, sf_dir, "train", SPARSE))
    scaler = sc.fit_scaler(tb.event_frames(spark, sf_dir), declared, tb.EVENT_FEATURES)
    late = F.when(F.col("stop") % 3 == 0, 6).otherwise(0)
    fitted = declared.withColumn("stop", F.col("stop") + late)
    return ct.counted(ct.validate_scaler(scaler, fitted, declared))
