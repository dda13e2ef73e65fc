"""Plain-SQL twins of the testbed tables, for checking results in another engine."""


def r(expression, digits=6):
    """Round half up, with the tie moved off the values that sums of two-decimal
    numbers produce, so both engines agree whatever order they add in."""
    return f"floor(({expression}) * 1e{digits} + 0.50037) / 1e{digits}"


EVENTS = """
ev AS (
  SELECT 'u' || user_id AS trajectory_id, user_id, event_id, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    value, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS k,
    coalesce((epoch_us(ts) - lag(epoch_us(ts))
      OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 0) AS gap_s
  FROM events),
tr AS (
  SELECT 'u' || user_id AS trajectory_id, user_id, count(*) AS n,
    's' || (user_id // 3) AS system_id, 'g' || (user_id // 3) AS split_group_id,
    'c' || (user_id // 9) AS group_id, (user_id % 3 + 1)::VARCHAR AS replicate_id,
    CASE WHEN user_id // 9 % 5 <= 2 THEN 'train' WHEN user_id // 9 % 5 = 3
      THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN user_id % 9 = 8 THEN 's' || user_id
      ELSE ((user_id + 1) // 3)::VARCHAR END AS label
  FROM events GROUP BY user_id),
lf AS (
  SELECT trajectory_id, frame, 'value' AS feature_id, value AS x FROM ev
  UNION ALL SELECT trajectory_id, frame, 'k', k FROM ev),
lf3 AS (SELECT * FROM lf UNION ALL SELECT trajectory_id, frame, 'gap_s', gap_s FROM ev)
"""

MONTHS = """
mo AS (
  SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS quantity,
    sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*)::DOUBLE AS lines
  FROM lineitem GROUP BY ALL),
mf AS (
  SELECT 'p' || l_suppkey AS trajectory_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY month) - 1 AS frame,
    quantity, revenue, lines FROM mo),
tr AS (
  SELECT 'p' || s_suppkey AS trajectory_id, s_suppkey, count(*) AS n,
    'p' || s_suppkey AS system_id, 'n' || s_nationkey AS split_group_id,
    'n' || s_nationkey AS group_id,
    CASE WHEN s_nationkey % 5 <= 2 THEN 'train' WHEN s_nationkey % 5 = 3
      THEN 'validation' ELSE 'test' END AS split
  FROM mo JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey),
lf AS (
  SELECT trajectory_id, frame, 'quantity' AS feature_id, quantity AS x FROM mf
  UNION ALL SELECT trajectory_id, frame, 'lines', lines FROM mf)
"""

GRIDS = {EVENTS: ((20,), (5, 10), 5), MONTHS: ((40,), (10,), 10)}
KEY = "trajectory_id, start, context_frames, horizon_frames"
CELL = "context_frames, horizon_frames"


def win(grid, split=None):
    """Windows `win` over `tr`."""
    contexts, horizons, stride = grid
    cells = ", ".join(f"({c}, {h})" for c in contexts for h in horizons)
    where = f"AND split = '{split}'" if split else ""
    return f"""
cells(context_frames, horizon_frames) AS (VALUES {cells}),
win AS (
  SELECT trajectory_id, system_id, group_id, split, context_frames, horizon_frames,
    unnest(range(0, n - context_frames - horizon_frames + 1, {stride})) AS start
  FROM tr, cells WHERE context_frames + horizon_frames <= n {where})
"""


CTX = """
ctx AS (
  SELECT w.*, f.feature_id, f.frame - w.start AS i, f.x
  FROM win w JOIN lf f ON f.trajectory_id = w.trajectory_id
    AND f.frame >= w.start AND f.frame < w.start + w.context_frames),
tgt AS (
  SELECT w.*, f.feature_id, f.frame - w.start - w.context_frames + 1 AS step,
    f.frame AS target_frame, f.x AS target
  FROM win w JOIN lf f ON f.trajectory_id = w.trajectory_id
    AND f.frame >= w.start + w.context_frames
    AND f.frame < w.start + w.context_frames + w.horizon_frames)
"""

POINTS = {
    "persistence": "origin",
    "context-mean": "mean",
    "linear": "icept + slope * (context_frames + step - 1)",
    "ar1": "pow(b, step) * origin + (my - b * mx) * "
    "CASE WHEN b = 1 THEN step ELSE (1 - pow(b, step)) / (1 - b) END",
    "ar1-ridge": "pow(rb, step) * origin + (my0 - rb * mx) * (1 - pow(rb, step)) / (1 - rb)",
}


def pred(base, models, split=None, grid=None):
    """CTEs from the base tables to prediction rows `pred`."""
    fields = (
        f"t.trajectory_id, t.start, t.context_frames, t.horizon_frames, system_id, group_id, "
        "split, t.feature_id, step, target_frame, origin, target"
    )
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS model, {fields}, {POINTS[m]} AS point "
        f"FROM tgt t JOIN st USING ({KEY}, feature_id) JOIN ar USING ({KEY}, feature_id)"
        for m in models
    )
    return f"""WITH {base}, {win(grid or GRIDS[base], split)}, {CTX},
st AS (
  SELECT {KEY}, feature_id, arg_max(x, i) AS origin, avg(x) AS mean,
    regr_slope(x, i) AS slope, regr_intercept(x, i) AS icept
  FROM ctx GROUP BY ALL),
lagged AS (
  SELECT {KEY}, feature_id, x AS y,
    lag(x) OVER (PARTITION BY {KEY}, feature_id ORDER BY i) AS z FROM ctx),
ar0 AS (
  SELECT {KEY}, feature_id, avg(z) AS mx, avg(y) AS my0, var_pop(z) AS v,
    covar_pop(y, z) AS c, count(*) AS np
  FROM lagged WHERE z IS NOT NULL GROUP BY ALL),
ar AS (
  SELECT {KEY}, feature_id,
    CASE WHEN v = 0 THEN mx * my0 / (mx * mx + 1) ELSE c / v END AS b, mx,
    CASE WHEN v = 0 THEN my0 / (mx * mx + 1) + mx * mx * my0 / (mx * mx + 1)
      ELSE my0 END AS my, my0, np * c / (np * v + 10) AS rb
  FROM ar0),
pred AS ({rows})
"""


REGIONS = """
seen AS (
  SELECT DISTINCT trajectory_id, start + unnest(range(context_frames)) AS frame
  FROM win WHERE split = 'train')
"""

SCALER = f"""{REGIONS},
scaler AS (
  SELECT feature_id, avg(x) AS center,
    CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS scale,
    count(*) AS sample_count
  FROM seen JOIN lf USING (trajectory_id, frame) GROUP BY feature_id)
"""

RESIDUALS = f"""
off AS (
  SELECT model, {CELL}, step, feature_id,
    least(quantile_cont(target - point, 0.1::DOUBLE), 0) AS o1, 0.0::DOUBLE AS o5,
    greatest(quantile_cont(target - point, 0.9::DOUBLE), 0) AS o9
  FROM pred WHERE split = 'train' GROUP BY ALL),
prob AS (
  SELECT p.*, point + o1 AS q1, point + o5 AS q5, point + o9 AS q9
  FROM pred p JOIN off USING (model, {CELL}, step, feature_id))
"""

LOSS = """
loss AS (
  SELECT p.*, abs(point - target) AS mae, (point - target) * (point - target) AS rmse,
    abs(point - target) / scale AS smae
  FROM pred p JOIN scaler USING (feature_id))
"""

PLOSS = """
ploss AS (
  SELECT p.*, abs(point - target) AS mae, (point - target) * (point - target) AS rmse,
    point - target AS bias,
    abs(point - target) / scale AS smae,
    greatest(0.1 * (target - q1), -0.9 * (target - q1)) AS p1,
    greatest(0.5 * (target - q5), -0.5 * (target - q5)) AS p5,
    greatest(0.9 * (target - q9), -0.1 * (target - q9)) AS p9,
    CASE WHEN target BETWEEN q1 AND q9 THEN 1.0::DOUBLE ELSE 0 END AS cov, q9 - q1 AS wid
  FROM prob p JOIN scaler USING (feature_id))
"""


def boot(source, population, series, policy):
    """Bootstrap of `source` (population, series, group_id, value) into `ci`.

    `ci` has mean, groups, ml, mu (marginal) and cl, cu (corrected) bounds.
    """
    pop, both = ", ".join(population), ", ".join([*population, *series])
    tails = []
    for corrected in (False, True):
        t = policy.tail(corrected)
        tails += [repr(t), repr(1 - t)]

    def bound(i, corrected):
        ok = policy.samples * policy.tail(corrected) >= policy.min_tail
        if not ok:
            return "NULL::DOUBLE"
        return f"CASE WHEN groups >= {policy.min_groups} THEN q[{i}] END"

    levels = ", ".join(f"{t}::DOUBLE" for t in tails)
    return f"""
gi AS (
  SELECT {pop}, group_id, count(*) OVER (PARTITION BY {pop}) AS groups,
    row_number() OVER (PARTITION BY {pop} ORDER BY md5(group_id), group_id) - 1 AS idx
  FROM (SELECT DISTINCT {pop}, group_id FROM {source})),
dr AS (
  SELECT {pop}, b, ('0x' || substr(md5('{policy.seed}|' || b || '|' || idx), 1, 8))::BIGINT
    % groups AS idx
  FROM gi, range({policy.samples}) t(b)),
kn AS (SELECT v.*, gi.idx, gi.groups FROM {source} v JOIN gi USING ({pop}, group_id)),
rs AS (
  SELECT {both}, b, avg(value) AS m FROM dr JOIN kn USING ({pop}, idx) GROUP BY {both}, b),
bd AS (SELECT {both}, quantile_cont(m, [{levels}]) AS q FROM rs GROUP BY {both}),
ci AS (
  SELECT {both}, e.mean, e.groups, {bound(1, False)} AS ml, {bound(2, False)} AS mu,
    {bound(3, True)} AS cl, {bound(4, True)} AS cu
  FROM (SELECT {both}, avg(value) AS mean, max(groups) AS groups FROM kn GROUP BY {both}) e
    JOIN bd USING ({both}))
"""


def status(groups, policy, corrected=False):
    ok = policy.samples * policy.tail(corrected) >= policy.min_tail
    other = "descriptive-bootstrap" if ok else "insufficient-bootstrap-resolution"
    return (
        f"CASE WHEN {groups} < {policy.min_groups} THEN 'insufficient-groups' "
        f"ELSE '{other}' END"
    )


def solved(source, keys, names, outputs, ridge, prefix="e"):
    """CTEs that solve penalised least squares from rows of `source` by elimination.

    `names` are the regressors' columns, `outputs` the targets'. Columns are centred per
    `keys`, so the level is free. The last CTE, `{prefix}w`, has `w_{name}_{output}`,
    `w0_{output}`, the cross sums `s_a_b`, `t_a_y`, `y_y` and the row count.
    """
    cross = lambda a, b: f"count(*) * covar_pop({a}, {b})"
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [f"{cross(a, b)} AS s_{a}_{b}" for a, b in pairs]
    sums += [f"{cross(a, y)} AS t_{a}_{y}" for a in names for y in outputs]
    sums += [f"{cross(y, y)} AS y_{y}" for y in outputs]
    sums += [f"avg({c}) AS m_{c}" for c in (*names, *outputs)]
    first = [f"s_{a}_{b}{f' + {ridge}' if a == b else ''} AS a0_{a}_{b}" for a, b in pairs]
    first += [f"t_{a}_{y} AS b0_{a}_{y}" for a in names for y in outputs]
    steps = [
        f"{prefix}s AS (SELECT {keys}, count(*) AS n, {', '.join(sums)} FROM {source} GROUP BY ALL)",
        f"{prefix}0 AS (SELECT *, {', '.join(first)} FROM {prefix}s)",
    ]
    for k, pivot in enumerate(names[:-1]):
        part = lambda a: f"a{k}_{pivot}_{a} / nullif(a{k}_{pivot}_{pivot}, 0)"  # noqa: B023, E731
        later = names[k + 1 :]
        columns = [
            f"a{k}_{a}_{b} - coalesce({part(a)}, 0) * a{k}_{pivot}_{b} AS a{k + 1}_{a}_{b}"
            for a, b in pairs if a in later and b in later
        ]
        columns += [
            f"b{k}_{a}_{y} - coalesce({part(a)}, 0) * b{k}_{pivot}_{y} AS b{k + 1}_{a}_{y}"
            for a in later for y in outputs
        ]
        steps.append(f"{prefix}{k + 1} AS (SELECT *, {', '.join(columns)} FROM {prefix}{k})")
    source = f"{prefix}{len(names) - 1}"
    for k in reversed(range(len(names))):
        a = names[k]
        columns = [
            f"coalesce((b{k}_{a}_{y}"
            + "".join(f" - a{k}_{a}_{b} * w_{b}_{y}" for b in names[k + 1 :])
            + f") / nullif(a{k}_{a}_{a}, 0), 0) AS w_{a}_{y}"
            for y in outputs
        ]
        steps.append(f"{prefix}r{k} AS (SELECT *, {', '.join(columns)} FROM {source})")
        source = f"{prefix}r{k}"
    level = [
        f"m_{y}" + "".join(f" - w_{a}_{y} * m_{a}" for a in names) + f" AS w0_{y}" for y in outputs
    ]
    steps.append(f"{prefix}w AS (SELECT *, {', '.join(level)} FROM {source})")
    return ", ".join(steps)


def left_over(names, y="y"):
    """The sum of squared residuals of the weights that `solved` found."""
    out = f"y_{y}" + "".join(f" - 2 * w_{a}_{y} * t_{a}_{y}" for a in names)
    for i, a in enumerate(names):
        out += f" + w_{a}_{y} * w_{a}_{y} * s_{a}_{a}"
        out += "".join(f" + 2 * w_{a}_{y} * w_{b}_{y} * s_{a}_{b}" for b in names[i + 1 :])
    return out
