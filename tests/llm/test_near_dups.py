import random

import brute
import pytest
from pyspark.sql import functions as F

from rollspan.llm import near_dups
from rollspan.llm.components import star_components


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    docs, n = [], 0
    for group in range(12):
        base = [f"g{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        for copy in range(rng.choice([1, 2, 9])):
            words = edited(rng, base, rng.choice([0, 1, 3, 6]) * len(base) // 120)
            docs.append((n, " ".join(words).upper() if copy == 1 else " ".join(words)))
            n += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(table, width):
    docs = corpus(width)
    got = near_dups.near_duplicates(table(docs), width=width).collect()
    want = brute.components(docs, width, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert any(r["doc_id"] != r["component_id"] for r in got)


def test_chain_that_the_star_misses(table, monkeypatch):
    """a ~ b ~ c ~ ... each step linked, the ends far apart."""
    rng = random.Random(3)
    words, docs = [f"t{i}" for i in range(200)], []
    for i in range(8):
        docs.append((i, " ".join(words)))
        words[25 * i : 25 * i + 4] = [f"n{i}{k}" for k in range(4)]
        words[199 - 20 * i] = f"m{rng.random()}"
    monkeypatch.setattr(near_dups, "BLOCK", 2)
    got = near_dups.near_duplicates(table(docs), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs, 4, 80)


@pytest.mark.parametrize("percent", [79, 50, 0])
def test_percent_that_would_lose_links_is_refused(table, percent):
    with pytest.raises(ValueError, match="below 80"):
        near_dups.near_duplicates(table([(1, "a b c d e f")]), percent=percent)


def test_odd_rows(table, odd_rows):
    got = near_dups.near_duplicates(table(odd_rows), width=5).collect()
    assert len(got) == len(odd_rows)
    sizes = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert sizes[1] == (0, 1, True) and sizes[2] == (0, 2, True) and sizes[5] == (0, 5, True)
    assert sizes[3] == (1, 3, True) and sizes[None] == (1, None, True)
    assert sizes[4][0] == len(brute.shingles(odd_rows[5][1], 5))
    assert near_dups.near_duplicates(table([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    df = spark.createDataFrame(edges + edges[:5], "u long, v long")
    got = {r["id"]: r["component"] for r in star_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert star_components(df.filter(F.lit(False))).count() == 0


def test_a_doc_id_with_two_texts_links_through_both(table):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (3, b + " more"), (4, a + " more"), (None, b + " still"), (9, "x y z"), (9, "x y z")]
    got = near_dups.near_duplicates(table(rows), width=4).collect()
    seen = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got)
    assert seen == [
        ("1", 1, True), ("1", 1, True), ("3", 1, False), ("4", 1, False), ("9", 9, True), ("9", 9, True), ("None", 1, False),
    ]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dups.without_duplicates(table(rows), width=4).collect())
    assert kept == [(1, a), (1, b), (9, "x y z")]


def test_one_row_of_each_group_stays(table, odd_rows):
    same = " ".join(f"s{i}" for i in range(30))
    rows = [*odd_rows, (None, same), (None, same), (8, same), (8, same), (8, same + " tail"), (7, same + " end")]
    docs = table(rows)
    kept = near_dups.without_duplicates(docs, width=5)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] and r["text"][:9]) for r in kept.collect())
    assert got == sorted([("1", None), ("2", ""), ("None", "no id her"), ("3", "twice the"), ("4", odd_rows[5][1][:9]), ("5", odd_rows[6][1]), ("7", same[:9])])
    assert near_dups.without_duplicates(table([])).count() == 0
    nulls = near_dups.without_duplicates(table([(None, same), (None, same), (None, same + " x")]), width=5)
    assert nulls.count() == 1


def test_links_of_one_unit_grow_with_its_components(spark):
    """Forty linked members of forty components need 39 links, not one per pair."""
    import numpy as np
    import pyarrow as pa

    base = np.arange(100, dtype="<u8")
    sets = [np.append(base, np.uint64(1000 + i)).tobytes() for i in range(40)]
    rows = [(u, i, i, side, sets[i]) for u in (1, 2) for i in range(40) for side in (True, False)]
    names = ["unit", "id", "component", "is_x", "set"]
    batch = pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)})
    got = [(a, b) for out in near_dups._exact(80)([batch]) for a, b in zip(*(out.column(c).to_pylist() for c in ("a", "b")))]
    assert len(got) == 39
    found = star_components(spark.createDataFrame(got, "u long, v long")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: 0 for i in range(1, 40)}
