"""Queries over series diagnostics, coupling and point clouds."""

from pyspark.sql import functions as F

from rollspan.operators import coupling as cp
from rollspan.operators import evidence as evi
from rollspan.operators import inference as inf
from rollspan.operators import points as pt
from rollspan.operators import series as sr
from rollspan.operators import windows as wn
from rollspan.plans import sql
from rollspan.plans import testbed as tb
from rollspan.plans.registry import query, rnd, rounded
from rollspan.plans.sql import EVENTS, GRIDS, KEY, MONTHS, boot, r
from rollspan.session import cut, scratch
from rollspan.sources import bundle

FEATURES = ["value", "k", "gap_s"]
LAGS = 10
CUTOFFS = {"value": 0.5, "k": 29.0, "gap_s": 1000.0}
POLICY = inf.Policy(seed=5, samples=200, min_groups=3, min_tail=1)

ACF = f"""
me AS (SELECT trajectory_id, feature_id, avg(x) AS m, count(*) AS n FROM lf3 GROUP BY ALL),
ce AS (SELECT trajectory_id, feature_id, frame, x - m AS c, n FROM lf3
  JOIN me USING (trajectory_id, feature_id)),
cv AS (
  SELECT a.trajectory_id, a.feature_id, lag, any_value(a.n) AS n, coalesce(sum(a.c * b.c), 0) AS s
  FROM ce a CROSS JOIN range({LAGS + 1}) t(lag) LEFT JOIN ce b
    ON b.trajectory_id = a.trajectory_id AND b.feature_id = a.feature_id
      AND b.frame = a.frame + lag
  GROUP BY ALL),
acf AS (
  SELECT a.trajectory_id, a.feature_id, a.lag, a.s / z.s AS rho
  FROM cv a JOIN cv z USING (trajectory_id, feature_id) WHERE z.lag = 0 AND a.lag < a.n),
dec AS (
  SELECT trajectory_id, feature_id, min(lag) FILTER (WHERE lag > 0 AND rho <= exp(-1)) AS decay,
    min(lag) FILTER (WHERE lag > 0 AND rho <= 0) AS stop FROM acf GROUP BY ALL)
"""


def curves(spark, sf_dir):
    return sr.acf(tb.event_frames_with_gap(spark, sf_dir), LAGS, FEATURES)


@query(
    "q1_q6_feature_qc",
    f"""WITH {EVENTS}, {ACF},
d AS (SELECT trajectory_id, feature_id,
    x - lag(x) OVER (PARTITION BY trajectory_id, feature_id ORDER BY frame) AS d FROM lf3),
ds AS (SELECT trajectory_id, feature_id, avg(d) AS dm, stddev_pop(d) AS dsd FROM d GROUP BY ALL),
j AS (SELECT trajectory_id, feature_id, count_if(abs(d - dm) > 2 * dsd)::BIGINT AS jumps,
  count(d) AS increments FROM d JOIN ds USING (trajectory_id, feature_id) GROUP BY ALL),
b AS (SELECT l.trajectory_id, l.feature_id, count(*) AS n, min(x) AS q0,
    quantile_cont(x, 0.25::DOUBLE) AS q1, quantile_cont(x, 0.5::DOUBLE) AS q2,
    quantile_cont(x, 0.75::DOUBLE) AS q3, max(x) AS q4, avg(x) AS mean, stddev_pop(x) AS sd,
    regr_slope(x, frame) AS drift,
    (avg(x) FILTER (WHERE frame >= m.n // 2) - avg(x) FILTER (WHERE frame < m.n // 2))
      / stddev_pop(x) AS shift
  FROM lf3 l JOIN me m USING (trajectory_id, feature_id) GROUP BY ALL)
SELECT trajectory_id, feature_id, n, 0::BIGINT AS missing, {r("q0")} AS q0, {r("q1")} AS q1,
  {r("q2")} AS q2, {r("q3")} AS q3, {r("q4")} AS q4, {r("mean")} AS mean, {r("sd")} AS std,
  false AS constant, sd <= CASE feature_id WHEN 'value' THEN 0.5 WHEN 'k' THEN 29 ELSE 1000 END
    AS near_constant, coalesce(decay, -1)::INTEGER AS decay_frames, decay IS NULL AS decay_censored,
  {r("drift", 4)} AS drift, {r("shift")} AS half_shift, jumps, increments
FROM b JOIN dec USING (trajectory_id, feature_id) JOIN j USING (trajectory_id, feature_id)""",
)
def q1(spark, sf_dir):
    qc = sr.feature_qc(tb.event_frames_with_gap(spark, sf_dir), CUTOFFS, LAGS, 2.0)
    flat = qc.select(
        *sr.SERIES, "n", "missing",
        *[rnd(F.element_at("quantiles", i + 1)).alias(f"q{i}") for i in range(5)],
        rnd("mean").alias("mean"), rnd("std").alias("std"), "constant", "near_constant",
        F.coalesce("decay_frames", F.lit(-1)).alias("decay_frames"), "decay_censored",
        rnd("drift", 4).alias("drift"), rnd("half_shift").alias("half_shift"),
        "jumps", "increments",
    )
    return flat


ACF_ROWS = f"""WITH {EVENTS}, {ACF}
SELECT trajectory_id, feature_id, lag::INTEGER AS lag, {r("rho")} AS acf FROM acf"""


@query("q2_autocorrelation", ACF_ROWS)
def q2(spark, sf_dir):
    return rounded(bundle.acf_rows(curves(spark, sf_dir)))


@query("s14_acf_csv", ACF_ROWS)
def s14(spark, sf_dir):
    path = scratch(spark)
    bundle.write_acf_csv(curves(spark, sf_dir), path)
    schema = "trajectory_id string, feature_id string, lag int, acf double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query(
    "q3_decay",
    f"""WITH {EVENTS}, {ACF} SELECT trajectory_id, feature_id,
  coalesce(decay, -1)::INTEGER AS decay_frames, decay IS NULL AS decay_censored FROM dec""",
)
def q3(spark, sf_dir):
    out = sr.decay(curves(spark, sf_dir))
    return out.select(
        *sr.SERIES, F.coalesce("decay_frames", F.lit(-1)).alias("decay_frames"), "decay_censored"
    )


@query(
    "q7_cross_correlation",
    f"""WITH {EVENTS} SELECT a.trajectory_id, a.feature_id AS feature_a, b.feature_id AS feature_b,
  {r("corr(a.x, b.x)")} AS correlation FROM lf3 a JOIN lf3 b USING (trajectory_id, frame)
GROUP BY ALL""",
)
def q7(spark, sf_dir):
    return rounded(sr.cross_correlation(tb.event_frames_with_gap(spark, sf_dir), FEATURES))


TIMES = f"""
ti AS (
  SELECT d.trajectory_id, d.feature_id, coalesce(any_value(decay), {LAGS}) AS decay,
    0.5 + coalesce(sum(rho) FILTER (WHERE lag > 0 AND (stop IS NULL OR lag < stop)), 0)
      AS integrated, any_value(decay) IS NULL AS censored
  FROM dec d JOIN acf USING (trajectory_id, feature_id) GROUP BY ALL)
"""


@query(
    "q9_correlation_times",
    f"""WITH {EVENTS}, {ACF}, {TIMES} SELECT trajectory_id, feature_id, decay::INTEGER AS decay,
  {r("integrated")} AS integrated, censored FROM ti""",
)
def q9(spark, sf_dir):
    out = sr.correlation_times(curves(spark, sf_dir), LAGS)
    return rounded(out.drop("n", "acf"))


@query(
    "q8_group_dependence",
    f"""WITH {EVENTS}, {ACF}, {TIMES},
lo AS (
  SELECT trajectory_id, feature_id, 'acf' AS measure, lag, rho AS value FROM acf
  UNION ALL SELECT trajectory_id, feature_id, 'decay', -1, decay FROM ti
  UNION ALL SELECT trajectory_id, feature_id, 'integrated', -1, integrated FROM ti
  UNION ALL SELECT trajectory_id, feature_id, 'censored', -1, censored::INT FROM ti),
vals AS (SELECT feature_id, split_group_id AS group_id, measure, lag, avg(value) AS value
  FROM lo JOIN tr USING (trajectory_id) GROUP BY ALL),
{boot("vals", ["feature_id"], ["measure", "lag"], POLICY)}
SELECT feature_id, measure, lag::INTEGER AS lag, {r("mean")} AS value,
  CASE WHEN measure <> 'censored' THEN {r("ml")} END AS ci_lower,
  CASE WHEN measure <> 'censored' THEN {r("mu")} END AS ci_upper, groups,
  (SELECT count(*) FROM tr) AS trajectories, 0::BIGINT AS constant_trajectories FROM ci""",
)
def q8(spark, sf_dir):
    groups = tb.event_trajectories(spark, sf_dir).select(
        "trajectory_id", F.col("split_group_id").alias("group_id")
    )
    return rounded(sr.dependence_summary(cut(curves(spark, sf_dir)), groups, LAGS, POLICY))


@query(
    "g32_qc_summary",
    f"""WITH {EVENTS}, {ACF}
SELECT feature_id, count_if(decay IS NULL)::BIGINT AS censored,
  {r("quantile_cont(rho, 0.5::DOUBLE)")} AS median_acf_lag1,
  {r("quantile_cont(decay::DOUBLE, 0.5::DOUBLE)")} AS median_decay
FROM dec JOIN (SELECT * FROM acf WHERE lag = 1) USING (trajectory_id, feature_id) GROUP BY ALL""",
)
def g32(spark, sf_dir):
    return rounded(evi.qc_summary(cut(sr.decay(curves(spark, sf_dir)))))


WIN = f"WITH {EVENTS}, {sql.win(sql.GRIDS[EVENTS])}, {sql.CTX}"
LEAD = f"""
ab AS (
  SELECT {KEY}, group_id, a.i, a.x AS a, b.x AS b FROM ctx a
  JOIN (SELECT {KEY}, i, x FROM ctx WHERE feature_id = 'k') b USING ({KEY}, i)
  WHERE a.feature_id = 'value'),
lc AS (
  SELECT p.trajectory_id, p.start, p.context_frames, p.horizon_frames, p.group_id, lag,
    greatest(-1, least(1, corr(p.a, q.b))) AS rho
  FROM ab p CROSS JOIN range(-3, 4) t(lag) JOIN ab q
    ON q.trajectory_id = p.trajectory_id AND q.start = p.start
      AND q.context_frames = p.context_frames AND q.horizon_frames = p.horizon_frames
      AND q.i = p.i + lag
  GROUP BY ALL)
"""


def event_pairs(spark, sf_dir):
    return cp.paired_contexts(tb.event_channels(spark, sf_dir), "value", "k")


@query(
    "q10_lag_correlation",
    f"""{WIN}, {LEAD} SELECT {KEY}, lag::INTEGER AS lag, {r("rho")} AS correlation FROM lc""",
)
def q10(spark, sf_dir):
    out = cp.lag_correlation(event_pairs(spark, sf_dir), 3)
    return rounded(out.drop("system_id", "group_id"))


@query(
    "q11_lag_gain",
    f"""{WIN}, {LEAD},
z AS (SELECT {KEY}, i, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a,
    (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b FROM ab WINDOW w AS (PARTITION BY {KEY})),
l AS (SELECT {KEY}, b AS y, lag(b) OVER w AS u, lag(a) OVER w AS v FROM z
  WINDOW w AS (PARTITION BY {KEY} ORDER BY i)),
s AS (SELECT {KEY}, count(*) * var_pop(u) AS uu, count(*) * var_pop(v) AS vv,
    count(*) * covar_pop(u, v) AS uv, count(*) * covar_pop(u, y) AS uy,
    count(*) * covar_pop(v, y) AS vy, count(*) * var_pop(y) AS yy
  FROM l WHERE u IS NOT NULL GROUP BY ALL),
f AS (SELECT *, uy / (uu + 1) AS o, (uu + 1) * (vv + 1) - uv * uv AS det FROM s),
g AS (SELECT *, ((vv + 1) * uy - uv * vy) / det AS bu, ((uu + 1) * vy - uv * uy) / det AS bv FROM f)
SELECT {KEY}, {r('''1 - (yy - 2 * (bu * uy + bv * vy) + bu * bu * uu + 2 * bu * bv * uv
  + bv * bv * vv) / (yy - 2 * o * uy + o * o * uu)''')} AS gain FROM g""",
)
def q11(spark, sf_dir):
    out = cp.lag_gain(event_pairs(spark, sf_dir), 1, 1.0)
    return rounded(out.drop("system_id", "group_id"))


TWO_LAGS = f"""WITH {MONTHS}, {sql.win(GRIDS[MONTHS])}, {sql.CTX},
zs AS (
  SELECT {KEY}, i, feature_id, (x - avg(x) OVER w)
    / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END AS z
  FROM ctx WINDOW w AS (PARTITION BY {KEY}, feature_id)),
pv AS (
  SELECT {KEY}, i, max(z) FILTER (WHERE feature_id = 'lines') AS a,
    max(z) FILTER (WHERE feature_id = 'quantity') AS b FROM zs GROUP BY ALL),
lg AS (
  SELECT {KEY}, b AS y, lag(b, 2) OVER w AS p, lag(b) OVER w AS q, lag(a, 2) OVER w AS s,
    lag(a) OVER w AS t FROM pv WINDOW w AS (PARTITION BY {KEY} ORDER BY i)),
full_lg AS (SELECT * FROM lg WHERE p IS NOT NULL),
{sql.solved("full_lg", KEY, ("p", "q"), ("y",), 1, "e")},
{sql.solved("full_lg", KEY, ("p", "q", "s", "t"), ("y",), 1, "j")},
alone AS (SELECT {KEY}, {sql.left_over(("p", "q"))} AS base FROM ew),
joint AS (SELECT {KEY}, {sql.left_over(("p", "q", "s", "t"))} AS rest FROM jw)
SELECT {KEY}, CASE WHEN base > 2.220446049250313e-16 THEN {r("1 - rest / base")} END AS gain
FROM alone JOIN joint USING ({KEY})"""


@query("q11_lag_gain_two_lags_months", TWO_LAGS)
def q11_two(spark, sf_dir):
    pairs = cp.paired_contexts(tb.month_channels(spark, sf_dir), "lines", "quantity")
    return rounded(cp.lag_gain(pairs, 2, 1.0).drop("system_id", "group_id"))


@query(
    "q12_lag_summary",
    f"""{WIN}, {LEAD}, t AS (
  SELECT group_id, trajectory_id, lag, avg(rho) AS v FROM lc GROUP BY ALL),
g AS (SELECT group_id, lag, avg(v) AS v FROM t GROUP BY ALL)
SELECT lag::INTEGER AS lag, {r("quantile_cont(v, 0.5::DOUBLE)")} AS median_correlation,
  count(*) AS groups FROM g GROUP BY lag""",
)
def q12(spark, sf_dir):
    return rounded(cp.lag_summary(cp.lag_correlation(event_pairs(spark, sf_dir), 3)))


CLOUD = """WITH
ats AS (
  SELECT 'e' || label AS trajectory_id, i::INTEGER AS atom,
    row_number() OVER (PARTITION BY label, i ORDER BY vec_id) - 1 AS frame,
    embedding[3 * i + 1]::DOUBLE AS x, coalesce(embedding[3 * i + 2]::DOUBLE, 0) AS y,
    coalesce(embedding[3 * i + 3]::DOUBLE, 0) AS z
  FROM embeddings, range(22) t(i)),
pa AS (
  SELECT trajectory_id, frame, a.atom AS a, b.atom AS b, a.x - b.x AS dx, a.y - b.y AS dy,
    a.z - b.z AS dz
  FROM ats a JOIN ats b USING (trajectory_id, frame)
  WHERE a.atom < 14 AND b.atom >= 14 AND a.atom % 5 <> 4 AND b.atom % 5 <> 4),
di AS (
  SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d,
    sqrt(pow(dx - 0.5 * floor(dx / 0.5 + 0.5), 2) + pow(dy - 0.5 * floor(dy / 0.5 + 0.5), 2)
      + pow(dz - 0.5 * floor(dz / 0.5 + 0.5), 2)) AS p
  FROM pa)
"""


def labelled(spark, sf_dir):
    sides = pt.heavy_sets(tb.cloud_atoms(spark, sf_dir), tb.cloud_segments(spark, sf_dir))
    return pt.label_points(tb.cloud(spark, sf_dir), sides)


@query(
    "p1_heavy_sets",
    """SELECT DISTINCT 'e' || label AS system_id, i::INTEGER AS atom,
  CASE WHEN i < 14 THEN 'receptor' ELSE 'ligand' END AS side
FROM embeddings, range(22) t(i) WHERE i % 5 <> 4""",
)
def p1(spark, sf_dir):
    return pt.heavy_sets(tb.cloud_atoms(spark, sf_dir), tb.cloud_segments(spark, sf_dir))


@query(
    "p2_contacts",
    f"""{CLOUD} SELECT trajectory_id, frame, count_if(d <= 0.2)::BIGINT AS contacts FROM di
GROUP BY ALL""",
)
def p2(spark, sf_dir):
    return pt.contacts(labelled(spark, sf_dir), tb.CUTOFF)


@query(
    "p3_reference_fraction",
    f"""{CLOUD}, rf AS (SELECT trajectory_id, a, b FROM di WHERE frame = 0 AND d <= 0.2),
n0 AS (SELECT trajectory_id, count(*) AS n FROM rf GROUP BY ALL)
SELECT trajectory_id, frame, {r("count_if(d <= 0.2 AND rf.a IS NOT NULL) / any_value(n)")}
  AS fraction
FROM di LEFT JOIN rf USING (trajectory_id, a, b) JOIN n0 USING (trajectory_id) GROUP BY ALL""",
)
def p3(spark, sf_dir):
    return rounded(pt.reference_fraction(labelled(spark, sf_dir), tb.CUTOFF))


@query(
    "p4_minimum_distance",
    f"""{CLOUD} SELECT trajectory_id, frame, {r("min(d)")} AS minimum FROM di GROUP BY ALL""",
)
def p4(spark, sf_dir):
    return rounded(pt.min_distance(labelled(spark, sf_dir)))


@query(
    "p5_region_distance",
    f"""{CLOUD} SELECT trajectory_id, frame, {r("min(d)")} AS minimum FROM di
WHERE a < 6 AND b >= 17 GROUP BY ALL""",
)
def p5(spark, sf_dir):
    atoms = tb.cloud_atoms(spark, sf_dir).filter("atomic_number > 1")
    regions = atoms.select(
        "system_id", "atom",
        F.when(F.col("atom") < 6, "receptor").when(F.col("atom") >= 17, "ligand").alias("side"),
    ).filter("side is not null")
    return rounded(pt.region_distance(tb.cloud(spark, sf_dir), regions))


@query(
    "p6_region_selection",
    f"""{CLOUD}, re AS (
  SELECT trajectory_id AS system_id, a // 3 AS residue, min(d) AS d FROM di WHERE frame = 0
  GROUP BY ALL)
SELECT system_id, residue::INTEGER AS residue, (residue * 3 + 1)::INTEGER AS atom,
  CASE WHEN d <= 0.1 THEN 'pocket' ELSE 'distal' END AS region
FROM re WHERE d <= 0.1 OR d >= 0.15""",
)
def p6(spark, sf_dir):
    first = tb.cloud(spark, sf_dir).filter(F.col("frame") == 0)
    static = first.join(tb.cloud_atoms(spark, sf_dir), ["system_id", "atom"]).select(
        "system_id", "atom", "residue", "atomic_number",
        F.when(F.col("atom") % 3 == 1, "CA").otherwise("X").alias("name"),
        (F.col("atom") >= 14).alias("ligand"),
        "x", "y", "z",
    )
    return pt.select_regions(static, pt.RegionRules(0.1, 0.15, 0))


@query(
    "p7_radius_of_gyration",
    f"""{CLOUD} SELECT trajectory_id, frame, CASE WHEN atom // 3 % 2 = 0 THEN 'pocket'
  ELSE 'distal' END AS region, {r("sqrt(var_pop(x) + var_pop(y) + var_pop(z))")} AS radius
FROM ats GROUP BY ALL""",
)
def p7(spark, sf_dir):
    regions = tb.cloud_atoms(spark, sf_dir).select(
        "system_id", "atom",
        F.when(F.col("residue") % 2 == 0, "pocket").otherwise("distal").alias("region"),
    )
    return rounded(pt.radius_of_gyration(tb.cloud(spark, sf_dir), regions))


@query(
    "p8_periodic_audit",
    f"""{CLOUD}, rf AS (SELECT trajectory_id, a, b, d <= 0.2 AS rd, p <= 0.2 AS rp FROM di
  WHERE frame = 0),
fr AS (
  SELECT trajectory_id, frame, count_if(d <= 0.2) AS cd, count_if(p <= 0.2) AS cp,
    count_if(d <= 0.2 AND rd) / count_if(rd) AS fd, count_if(p <= 0.2 AND rp) / count_if(rp) AS fp,
    min(d) AS md, min(p) AS mp
  FROM di JOIN rf USING (trajectory_id, a, b) GROUP BY ALL)
SELECT trajectory_id, count(*) AS frames, count_if(cd <> cp)::BIGINT AS count_different_frames,
  count_if(fd <> fp)::BIGINT AS fraction_different_frames,
  {r("max(abs(md - mp))")} AS max_minimum_difference FROM fr GROUP BY ALL""",
)
def p8(spark, sf_dir):
    boxes = tb.cloud(spark, sf_dir).select("trajectory_id", "frame").distinct().select(
        "trajectory_id", "frame", *[F.lit(tb.BOX).alias(f"l{x}") for x in pt.AXES]
    )
    return rounded(pt.periodic_audit(labelled(spark, sf_dir), boxes, tb.CUTOFF))
