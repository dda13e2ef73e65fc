import random
import zlib

import numpy as np
import pytest

from rollspan.llm import quality


def texts(rng, n):
    words = [f"{a}{b}{c}" for a in "tbr" for b in "aeo" for c in ("n", "rel", "st", "d")]
    rows = []
    for i in range(n):
        line = rng.choices(words, k=rng.randrange(5, 80))
        good = rng.random() < 0.7
        text = " ".join(line).capitalize() + "."
        if not good:
            text = rng.choice([" ".join(w.upper() + "!!" for w in line), " | ".join(line), " ".join([line[0]] * len(line)), " ".join(w + "###" for w in line)])
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy(spark, table, odd_rows):
    rows = texts(random.Random(1), 600)
    docs = table([r[:2] for r in rows] + [(r[0] and 10_000 + r[0], r[1]) for r in odd_rows])
    labels = [(i, y, 0) for i, _, y in rows] + [(5, None, 0), (10_004, 7, 0), (10_003, 0, 0), (10_003, 1, 0), (None, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, x int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd_rows)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


@pytest.mark.parametrize("n", [32, 33, 100, 1000])
def test_top_word_is_searched_in_the_whole_text(n):
    step = n // 16
    words = [f"w{i}" if i % step == 0 else "often" for i in range(n)]
    top, distinct = max(map(words.count, words)), len(set(words))
    got = dict(zip(quality.NAMES, quality.statistics(" ".join(words))))
    assert "often" not in words[::step] and top == words.count("often")
    assert got["top_word"] == quality._logit(top, n, 0.1, 10)
    assert got["distinct"] == quality._logit(distinct, n**0.9, 0.7, 10)


def test_one_class_and_no_labels_give_the_prior(spark, table):
    docs = table([(i, f"text {i}") for i in range(20)])
    some = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.classify(docs, some).collect())
    scores = {r["score"] for r in quality.classify(docs, some.limit(0)).collect()}
    assert scores == {0.5}
    assert quality.classify(table([]), some).count() == 0


def test_discriminant_is_the_gaussian_density_ratio(monkeypatch):
    monkeypatch.setattr(quality, "NAMES", ("a", "b"))
    for name in ("SHRINK_DIAGONAL", "SHRINK_POOLED", "FLOOR"):
        monkeypatch.setattr(quality, name, 0.0)
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (20_000, 2)) @ [[1, 0.5], [0, 2]], 1: rng.normal(1, 1, (60_000, 2))}
    sums = []
    for c, v in x.items():
        flat = np.concatenate([v.sum(axis=0), (v.T @ v).ravel()])
        sums += [{"label": c, "i": i, "k": len(v), "s": s} for i, s in enumerate(flat)]
    model = quality.discriminant(sums)
    point = np.array([[0.3, -0.2], [2.0, 1.0]])
    want = np.zeros(2)
    for c, sign in ((1, 1), (0, -1)):
        cov, mean = np.cov(x[c].T, bias=True), x[c].mean(axis=0)
        d = point - mean
        want += sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert quality.log_odds(model, point) == pytest.approx(want + np.log(3), abs=0.01)
