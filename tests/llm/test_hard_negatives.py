import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspan.llm import hard_negatives as hn

EXTRA = "anchor string, x string, name int, score string"


def brute(rows, every=50, scale=256, positives=5, negatives=3):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, label, [int(np.floor(float(np.float32(x)) * scale)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for vec_id, label, v in kept:
        if vec_id % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, other, w in kept if i != vec_id)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            for rank, (t, j, _) in enumerate(window[:negatives], 1):
                out.append((vec_id, i, rank, j, -s, -t))
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(
        [(*r, "?", "?", 1, "?") for r in rows], f"vec_id long, embedding array<float>, label int, {EXTRA}"
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(df, label, **more).collect())


def vectors(n, width, seed, labels=10):
    rng = np.random.default_rng(seed)
    return [
        (i, [float(x) for x in rng.normal(0.2, 0.4, width).astype(np.float32)], int(rng.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("every, chunk", [(50, 16_384), (3, 37)])
def test_against_brute_force(spark, monkeypatch, every, chunk):
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "TILE", 29)
    monkeypatch.setattr(hn, "ANCHORS", 16)
    rows = vectors(300, 7, every, labels=4)
    got = mined(spark, rows, every=every)
    assert got == brute(rows, every) and len(got) > 20


def test_ties_repeated_and_odd_rows(spark):
    rows = vectors(60, 5, 1, labels=2)
    rows += [rows[50], rows[50], rows[3], (100, rows[50][1], 1), (101, rows[50][1], 0), (102, rows[50][1], 0)]
    rows += [(150, None, 1), (151, [], 1), (152, [1.0, None], 1), (153, [float("nan")] * 5, 0), (154, [float("inf")] * 5, 0)]
    rows += [(200, [0.5, 0.25], 1), (None, [1.0] * 5, 1), (250, [1.0] * 5, None), (300, [0.0] * 5, 1)]
    got = mined(spark, rows, every=10)
    assert got == brute(rows, 10)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_hot_label_and_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 4)
    base = vectors(40, 6, 4, labels=1)
    rows = base + [base[0]] * 11 + [(i + 100, v, 3) for i, v, _ in base]
    assert mined(spark, rows, every=20) == brute(rows, 20)


@pytest.mark.parametrize("shape", [(1, 1, 1), (24, 24, 24), (50, 31, 77), (64, 64, 200), (3, 100, 100), (97, 96, 95)])
def test_strassen_is_the_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-2**28, 2**28, (m, k)), rng.integers(-2**28, 2**28, (k, n))
    assert (hn.strassen(a, b) == a @ b).all()


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="not supported"):
        mined(spark, [(0, [1e17], 1), (2, [1e17], 1)])
