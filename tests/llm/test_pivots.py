import math
import random

from rollspan.llm import pivots


def brute(rows, k, every):
    whole = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * x) for x in v]))
    out = set()
    for i, q in whole:
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(600, None), (610, []), (620, [None] * 8), (630, [math.nan] * 8), (640, [math.inf] + [0.0] * 7), (None, rows[0][1]), (650, [0.5, -0.25])]
    df = spark.createDataFrame([(*r, "?") for r in rows], "vec_id long, embedding array<double>, d string")
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 12)
    got = pivots.top_k(df, k=5, every=10).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 10)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivots.top_k(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.5, 0.5])], schema)
    assert {tuple(r) for r in pivots.top_k(two).collect()} == {(0, 1, 100, 524288), (100, 1, 0, 524288)}


def test_repeated_query_rows_get_their_rows_each(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(80)]
    rows += [rows[20], rows[20], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.top_k(df, k=10, every=20).collect())
    once = brute(rows, 10, 20)
    assert got == sorted(list(once) + 2 * [r for r in once if r[0] == 20])
