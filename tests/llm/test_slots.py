import zlib
from collections import defaultdict

from rollspan.llm import slots
from rollspan.session import cut


def loads(rows):
    sums = defaultdict(int)
    for r in rows:
        sums[r["shard"]] += r["size"]
    return sums


def test_sizes_positions_and_copies(table, odd_rows):
    rows = [(100 + i, "z" * (50 + i % 40) + str(i % 700)) for i in range(2000)] + odd_rows[:5]
    got = slots.shard_documents(table(rows), shards=8).collect()
    assert len(got) == len(rows)
    text = {d: t or "" for d, t in rows}
    places, homes = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        places[r["shard"]].append(r["slot"])
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sums = loads(got)
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) < 200
    assert all(len(h) == 1 for h in homes.values())
    assert slots.shard_documents(table([])).count() == 0


def test_hot_text_is_dealt_out(table):
    rows = [(i, "the same text " * 10) for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(3000)]
    sums = loads(slots.shard_documents(table(rows), shards=4).collect())
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values())


def test_rebalance_moves_into_the_new_shard_only(table):
    rows = [(i, "y" * (1 + i * 37 % 300)) for i in range(3000)]
    records = slots.with_slots(slots.digests(table(rows)), 5)
    sizes = cut(slots.slot_sizes(records))
    first = cut(slots.build_map(sizes, 5))
    second = slots.rebalance(first, sizes, 6)
    before = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    after = {r["virtual_slot"]: r["shard"] for r in second.collect()}
    assert {after[s] for s in after if after[s] != before[s]} == {5}
    assert {r["version"] for r in second.collect()} == {2}
    size = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    sums = defaultdict(int)
    for s, shard in after.items():
        sums[shard] += size[s]
    assert sums[5] > 0.9 * sum(sums.values()) / 6


def test_repeated_rows_are_dealt_out(table):
    rows = [(7, "r" * 1000)] * 3000 + [(5000 + i, f"other {i}") for i in range(3000)]
    got = slots.shard_documents(table(rows), shards=16).collect()
    sums = loads(got)
    assert len(got) == 6000 and len(sums) == 16
    assert max(sums.values()) - min(sums.values()) < 2002
