import random
from collections import Counter
import re

import pytest

from rollspan.llm import collocations as co


def brute(docs, least, longest, first):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = (lang, p[i : i + k])
                inside[part] = max(inside.get(part, 0), a)
    rows = []
    for (lang, p), a in candidates.items():
        if inside.get((lang, p), 0) >= a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        rows.append((lang, " ".join(p), a, l, r, n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out.extend((lang, i, *r[1:]) for i, r in enumerate(own[:first], 1))
    return sorted(out)


def corpus(seed, texts=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "N", "x\x85y", "🙂"]
    fixed = ["in the long run", "as far as i know it", "run in the long"]
    docs = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary[: rng.randrange(2, 29)]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "?!"]))
        docs.append((rng.choice(["en", "de", None]), "".join(parts)))
    return docs


@pytest.mark.parametrize("least, longest, first", [(8, 5, 2000), (3, 5, 7), (20, 3, 2000), (5, 2, 50)])
def test_against_brute_force(table, monkeypatch, least, longest, first):
    docs = corpus(least)
    monkeypatch.setattr(co, "TOKENS", 300)
    rows = table([(lang, text) for lang, text in docs], "lang string, text string")
    got = sorted(tuple(r) for r in co.collocations(rows, least, longest, first).collect())
    assert got == brute(docs, least, longest, first)
    assert got


def test_hot_prefixes_are_cut_into_segments(table, monkeypatch):
    """The table's parts and the stripes' segments are small; results stay the same."""
    docs = corpus(77, 200)
    monkeypatch.setattr(co, "CAP", 4)
    monkeypatch.setattr(co, "PART_SLOTS", 1 << 12)
    monkeypatch.setattr(co, "TOKENS", 500)
    rows = table(docs, "lang string, text string")
    words, levels = co.count_stripes(rows, 5, 5)
    assert levels[0].groupBy("lang", "prefix").count().filter("count > 1").count() > 0
    got = sorted(tuple(r) for r in co.collocations(rows, 5, 5, 2000).collect())
    assert got == brute(docs, 5, 5, 2000)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "STEP", 20)
    text = "one two three. " * 5 + "four " * 30 + "five, six"
    want = text.replace(".", " . ").replace(",", " . ").encode().split() + [b"."]
    got = [w for part in co._pieces(text) for w in part]
    strip = lambda words: [w for i, w in enumerate(words) if w != b"." or i and words[i - 1] != b"."]
    assert strip(got) == strip(want)
    assert max(len(p) for p in co._pieces(text)) < 40


def test_odd_rows(spark):
    rows = [("en", None), (None, ""), (None, "a b"), (None, "a b"), ("en", " \t\n"), ("", "a b . a b"), ("", ". . a b")]
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], "lang string, text string, prefix string, next int")
    got = sorted(tuple(r) for r in co.collocations(docs, 2, 5, 10).collect())
    assert got == brute(rows, 2, 5, 10)
    assert {r[0] for r in got} == {"und", ""}
    assert co.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    value = spark.sql(
        "SELECT (1000BD * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div "
        "(cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s "
        "FROM VALUES (7123456789012L, 98765432109876L, 71234567890125L, 8123456789012L) AS t(a, n, l, r)"
    ).first()["s"]
    assert value == 1000 * 7123456789012 * 98765432109876 // (71234567890125 * 8123456789012)
