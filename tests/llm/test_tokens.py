import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollspan.llm import packing, token_files, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_are_the_text(path):
    rng = random.Random(5)
    texts = ["don't  stop\n\nnow", "a\tb \n c", "  lead", "trail ", "½ cup_of x2 '90s isn't, so", "\0x y \0z", "<|endoftext|> hi"]
    texts += ["x  <|endoftext|>\n\n <|startoftext|>y.", "<|endoftext|<|endoftext|> ", "\0<|endoftext|>", "it's.\nO'Neil's '.\nx'\ny"]
    texts += ["".join(rng.choice(" \n\t.,'aBé1_-! ") for _ in range(rng.randrange(80))) for _ in range(600)]
    encoder, tokenizer = tokens.UnitEncoder(path), plain(path)
    ids, sizes = encoder.encode(pa.array(texts + [None, ""]))
    for text, own in zip(texts + ["", ""], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.with_ends(*encoder.encode(pa.array(["", None])), 7)[0].tolist() == [7, 7]
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


def test_cache_overflow_changes_nothing(monkeypatch):
    encoder = tokens.UnitEncoder(BYTE)
    texts = [f"word{i} other{i}, again" for i in range(60)]
    want = encoder.encode(pa.array(texts))[0].tolist()
    monkeypatch.setattr(tokens, "CACHE_LIMIT", 10)
    monkeypatch.setattr(tokens, "GATHER", 3)
    small = tokens.UnitEncoder(BYTE)
    assert [i for t in texts for i in small.encode(pa.array([t]))[0].tolist()] == want


def test_token_files_round_trip(spark, table, odd_rows):
    rows = [(9 - i, f"text number {i}, with words") for i in range(8)] + odd_rows
    folder = token_files.write_tokens(table(rows), WORD, end_id=2)
    got = token_files.read_tokens(spark, folder).collect()
    tokenizer, start = plain(WORD), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, text), row in zip(ordered, sorted(got, key=lambda r: r["start"])):
        ids = brute.encode(tokenizer, text, 2)
        assert tuple(row) == (doc_id, start, len(ids), brute.crc_of_ids(ids))
        start += len(ids)
    assert len(got) == len(rows)
    first = token_files.read_manifest(folder)[0]
    assert token_files.document_ids(folder, first, 0).tolist() == brute.encode(tokenizer, ordered[0][1], 2)
    empty = token_files.write_tokens(table([]), WORD)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_packing_covers_every_id(table, odd_rows):
    rows = [(20 + i, "some words to pack " * i) for i in range(30)] + odd_rows
    encoded = packing.encode_documents(table(rows), BYTE, 1)
    pieces = encoded.mapInArrow(packing._cut(packing.partition_bases(encoded), 64), packing.PIECES)
    tokenizer, held = plain(BYTE), {}
    for r in pieces.collect():
        held.setdefault(r["sequence_id"], []).append(r)
    assert sorted(held) == list(range(len(held)))
    stream, crcs = 0, []
    for s in sorted(held):
        at = 0
        for r in sorted(held[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            crcs.append((r["doc_id"], r["start"], r["ids_crc32"], r["length"], r["doc_tokens"]))
        assert at == 64 or s == max(held)
        stream += at
    want = [(d, brute.encode(tokenizer, t, 1)) for d, t in rows]
    assert stream == sum(len(ids) for _, ids in want)
    expected = {(d, tuple(ids)) for d, ids in want}
    for doc_id, start, crc, length, total in crcs:
        assert any(d == doc_id and len(i) == total and brute.crc_of_ids(i[start : start + length]) == crc for d, i in expected)
    whole = packing.sequences(encoded, pieces, 64).collect()
    assert sum(len(p["ids"]) for r in whole for p in r["pieces"]) == 2 * stream
    assert packing.pack(table([]), BYTE).count() == 0
