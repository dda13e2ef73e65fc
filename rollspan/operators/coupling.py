"""Lead-lag diagnostics inside each observed context."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rollspan.functions.arrays import deviations, dot, let, total
from rollspan.functions.quantiles import exact_quantiles
from rollspan.session import cut
from rollspan.tables import WINDOW_KEY


def paired_contexts(channels, a, b):
    """Contexts of two features side by side; targets are not read."""

    def pick(name):
        found = F.filter("channels", lambda c: c["feature_id"] == name)
        return F.get(found, 0)["context"]

    return channels.select(
        *WINDOW_KEY, "system_id", "group_id", pick(a).alias("a"), pick(b).alias("b")
    )


def _lagged_pearson(a, b, max_lag):
    """Correlations of (windows, frames) batches for lags -max_lag..max_lag."""
    size = a.shape[1]
    out = np.full((len(a), 2 * max_lag + 1), np.nan)
    for lag in range(-max_lag, max_lag + 1):
        x = a[:, max(-lag, 0) : size - max(lag, 0)]
        y = b[:, max(lag, 0) : size - max(-lag, 0)]
        # The first value goes first, so constants leave exact zeros.
        x, y = x - x[:, :1], y - y[:, :1]
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        ok = norm != 0
        out[ok, lag + max_lag] = np.clip((x * y).sum(axis=1)[ok] / norm[ok], -1, 1)
    return out


def lag_correlation(pairs, max_lag):
    """Q10: Pearson of A(t) and B(t + lag) for lags -L..L, clipped; null on zero norm.

    Windows of one Arrow batch and size are solved together; measured, this costs a
    hundredth of the same sums written as array lambdas.
    """

    @F.pandas_udf("array<double>")
    def curve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        sizes = a.map(len).to_numpy()
        for size in np.unique(sizes):
            if size < max_lag + 2:
                raise ValueError("lags need two paired samples")
            at = np.flatnonzero(sizes == size)
            solved = _lagged_pearson(
                np.stack(a.iloc[at].to_numpy()), np.stack(b.iloc[at].to_numpy()), max_lag
            )
            for i, row in zip(at, solved):
                out[i] = row
        return pd.Series(out)

    rows = pairs.select(
        *WINDOW_KEY, "system_id", "group_id", curve("a", "b").alias("_curve")
    ).select(*WINDOW_KEY, "system_id", "group_id", F.posexplode("_curve").alias("_pos", "_r"))
    return rows.select(
        *WINDOW_KEY, "system_id", "group_id",
        (F.col("_pos") - max_lag).alias("lag"),
        F.nullif("_r", F.lit(float("nan"))).alias("correlation"),
    )


def lag_gain(pairs, lags=1, ridge=1.0):
    """Q11: 1 - SSE(B on lags of B and A) / SSE(B on lags of B), standardised.

    One lag with a penalty is solved from cross products in the JVM; anything else
    by small batched least squares.
    """
    gain = _gain_one(ridge) if lags == 1 and ridge > 0 else _gain_many(lags, ridge)
    return pairs.select(*WINDOW_KEY, "system_id", "group_id", gain.alias("gain"))


def _standard(values):
    def scaled(s):
        spread = F.sqrt(dot(s, s) / F.size(s))
        return let(
            F.struct(s.alias("v"), F.when(spread == 0, 1.0).otherwise(spread).alias("s")),
            lambda t: F.transform(t["v"], lambda x: x / t["s"]),
        )

    return let(deviations(values), scaled)


def _gain_one(ridge):
    """Centred cross products of y = B(t), u = B(t-1), v = A(t-1)."""
    lam = F.lit(float(ridge))

    def solve(s):
        suu, svv, suv = dot(s["u"], s["u"]), dot(s["v"], s["v"]), dot(s["u"], s["v"])
        suy, svy, syy = dot(s["u"], s["y"]), dot(s["v"], s["y"]), dot(s["y"], s["y"])
        return let(
            F.struct(*[
                c.alias(n)
                for n, c in dict(uu=suu, vv=svv, uv=suv, uy=suy, vy=svy, yy=syy).items()
            ]),
            fit,
        )

    def fit(k):
        one = k["uy"] / (k["uu"] + lam)
        base = k["yy"] - 2 * one * k["uy"] + one * one * k["uu"]
        det = (k["uu"] + lam) * (k["vv"] + lam) - k["uv"] * k["uv"]
        bu = ((k["vv"] + lam) * k["uy"] - k["uv"] * k["vy"]) / det
        bv = ((k["uu"] + lam) * k["vy"] - k["uv"] * k["uy"]) / det
        joint = (
            k["yy"] - 2 * (bu * k["uy"] + bv * k["vy"])
            + bu * bu * k["uu"] + 2 * bu * bv * k["uv"] + bv * bv * k["vv"]
        )
        return F.when(base > float(np.finfo(float).eps), 1 - joint / base)

    def shifted(s):
        n = F.size(s["b"]) - 1
        return let(
            F.struct(
                deviations(F.slice(s["b"], F.lit(2), n)).alias("y"),
                deviations(F.slice(s["b"], F.lit(1), n)).alias("u"),
                deviations(F.slice(s["a"], F.lit(1), n)).alias("v"),
            ),
            solve,
        )

    both = F.struct(_standard(F.col("a")).alias("a"), _standard(F.col("b")).alias("b"))
    return F.when(F.size("b") - 1 >= 3, let(both, shifted)).otherwise(
        F.raise_error(F.lit("too few observations for the lagged regression"))
    )


def _residual(design, labels, ridge):
    windows, rows, width = design.shape
    fitted, wanted = design, labels
    if ridge > 0:
        penalty = np.diag(np.append(np.full(width - 1, np.sqrt(ridge)), 0.0))
        fitted = np.concatenate([design, np.broadcast_to(penalty, (windows, width, width))], axis=1)
        wanted = np.concatenate([labels, np.zeros((windows, width, 1))], axis=1)
    weights = np.linalg.pinv(fitted, rcond=max(fitted.shape[1:]) * np.finfo(float).eps) @ wanted
    return ((design @ weights - labels) ** 2).sum(axis=(1, 2))


def _gain_many(lags, ridge):
    @F.pandas_udf("double")
    def gain(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        sizes = a.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            values = np.stack(
                [np.stack(b.iloc[at].to_numpy()), np.stack(a.iloc[at].to_numpy())], axis=2
            )
            rows = size - lags
            if rows < 2 * lags + 1:
                raise ValueError("too few observations for the lagged regression")
            spread = values.std(axis=1, keepdims=True)
            spread[spread == 0] = 1.0
            z = (values - values.mean(axis=1, keepdims=True)) / spread
            ones = np.ones((len(at), rows, 1))
            past = [z[:, k : rows + k, :] for k in range(lags)]
            labels = z[:, lags:, :1]
            alone = np.concatenate([p[:, :, :1] for p in past] + [ones], axis=2)
            joint = np.concatenate(past + [ones], axis=2)
            base = _residual(alone, labels, ridge)
            ok = base > np.finfo(float).eps
            ratio = _residual(joint, labels, ridge)[ok] / base[ok]
            out[at[ok]] = 1 - ratio
        return pd.Series(out)

    raw = gain(F.col("a"), F.col("b"))
    return F.nullif(raw, F.lit(float("nan")))


def lag_summary(diagnostics, value="correlation"):
    """Q12: replica mean per group, then the exact median over groups, per lag.

    Replicas weigh by their windows' mean first, as every trajectory of a group has
    its own number of windows. One row per group and lag is written out.
    """
    replica = diagnostics.groupBy("group_id", "trajectory_id", "lag").agg(F.avg(value).alias("_v"))
    group = cut(replica.groupBy("group_id", "lag").agg(F.avg("_v").alias("_v")))
    held = group.filter(F.col("_v").isNotNull())
    medians = exact_quantiles(held, ["lag"], "_v", (0.5,), "_q")
    counts = group.groupBy("lag").agg(F.count("_v").alias("groups"))
    return counts.join(medians, "lag", "left").select(
        "lag", F.element_at("_q", 1).alias(f"median_{value}"), "groups"
    )
