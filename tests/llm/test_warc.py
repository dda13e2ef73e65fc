import base64
import hashlib
import io
from collections import defaultdict

import pytest

from rollspan.llm import warc

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://c/ü\r\n", "é" * 9000),
         (4, "http://d/", None), (5, "http://e/", ""), (None, "http://f/", "<p>one</p>"), (6, "http://g/", "lone"), (6, "http://g/", "lone"), (None, "http://h/", "no id")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "?", 1) for p in PAGES], "page_id long, url string, html string, mark string, latest int")
    folder, files = warc.write_archives(df)
    rows = warc.read_archives(spark, folder, files, payloads=True).collect()
    assert {r["kind"] for r in rows} == {"record"} and len(rows) == len(PAGES)
    latest = defaultdict(int)
    for i, _, html in PAGES:
        latest[html or ""] = max(latest[html or ""], i or 0)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        top = latest[html or ""]
        old = top > 0 and (i or 0) < top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if old else "response", top if old else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    body = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert body[3] == ("é" * 9000).encode()


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.plan_records(df, least_bytes=100).filter("refers_to is not null").count() == 0


def test_rotation_and_empty_table(spark):
    df = spark.createDataFrame([(i, "http://x/", f"page {i}") for i in range(40)], "page_id long, url string, html string")
    folder, files = warc.write_archives(df.coalesce(1), rotate=2000)
    assert len(files) > 3 and warc.read_archives(spark, folder, files).count() == 40
    folder, files = warc.write_archives(df.limit(0))
    assert warc.read_archives(spark, folder, files).count() == 0


RECORDS = [warc.format_record(i, f"http://x/{i}", b"payload %d " % i * 300, None) for i in range(12)]


def walk(data):
    out = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [o[1] for o in out] == [0, *[o[2] for o in out]][:-1] and (not out or out[-1][2] == len(data))
    return [int(o[4]["x-page-id"]) for o in out if o[0] == "record"], [o[1:3] for o in out if o[0] == "gap"]


def flip(data, at):
    data = bytearray(data)
    data[at] ^= 0xFF
    return bytes(data)


@pytest.mark.parametrize("packed", [True, False])
def test_every_damage_costs_one_record(packed):
    parts = [warc.deflate(r) if packed else r for r in RECORDS]
    whole, starts = b"".join(parts), [sum(map(len, parts[:i])) for i in range(12)]
    assert walk(whole) == (list(range(12)), [])
    for at in (2, 40, len(parts[5]) - 6):
        pages, gaps = walk(flip(whole, starts[5] + at))
        assert pages == [*range(5), *range(6, 12)] and gaps == [(starts[5], starts[6])]
    pages, gaps = walk(whole[:-7])
    assert pages == list(range(11)) and gaps == [(starts[11], len(whole) - 7)]
    pages, gaps = walk(whole[: starts[3]] + b"junk \x1f\x8b\x08 WARC/1.1 \n" + whole[starts[3] :])
    assert pages == list(range(12)) and len(gaps) == 1
    pages, gaps = walk(b"".join(parts[:4]) + parts[4][: len(parts[4]) // 2] + b"".join(parts[5:]))
    assert pages == [*range(4), *range(5, 12)] and len(gaps) == 1


def test_wrong_digest_and_nothing():
    bad = RECORDS[2].replace(b"payload 2 ", b"payload X ", 1)
    pages, gaps = walk(b"".join(map(warc.deflate, [RECORDS[1], bad, RECORDS[3]])))
    assert pages == [1, 3] and len(gaps) == 1
    assert walk(b"") == ([], []) and walk(b"no archive at all") == ([], [(0, 17)])
