"""Tokenizer ids of whole texts, through cached encodings of space-separated units.

Both public tokenizers cut a text in front of every space that follows a non-space, so
the ids of a text are the ids of its units in a row. A batch of texts is cut and its
distinct units are numbered by Arrow; each new unit is encoded once by the `tokenizers`
library and kept in a bounded cache of id bytes; ids are then gathered by number. A new
unit of plain words and punctuation is put together from its parts, which the
tokenizers also keep apart. Signs between a word and a space, and a line's end between
two signs or words, become units at once, so a word is not encoded again for everything
that follows it. Special tokens' strings give their one id, as in the library's plain call.
"""

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rollspan.llm import worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads

SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ODD = "^ |\\x00|[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "] "
_LINE = r"([\pL\pN!-~])\n([\pL\pN!-~])"
_SIGN = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)( |$)"
_CUT = re.compile(r"(?<=\S)(?= )")
_PARTS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+|\n")
CACHE_LIMIT = 200_000
UNIT_LIMIT = 64
GATHER = 500_000  # units gathered at a time
SLICE = 4_000_000  # characters encoded at a time

_ENCODERS = {}


def encoder(path):
    """The worker's encoder of a tokenizer file; it lives as long as the worker."""
    worker.enter("tokens")
    worker.keep("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = UnitEncoder(path)
        worker.release()
    return _ENCODERS[path]


class UnitEncoder:
    """Little-endian ids of texts (two bytes an id up to 65,536 ids, else four).

    The cache has two generations: units of the older one that come up again move to
    the younger one, and the older one goes when the younger is full.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache, self.older = {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.by_end = any(t.endswith("</w>") for t in vocabulary)
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.bound[i] = token.endswith("</w>") if self.by_end else token.startswith("\u0120")
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("special tokens that take in what is around them are not supported")
        self.special = {t.content: array(self.code, [i]).tobytes() for i, t in added.items()}
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.parted = re.compile(f"({names})") if names else None
        self.odd = f"{_ODD}|{names}" if names else _ODD

    def encode(self, texts):
        """(ids of all texts in a row, ids per text) of an Arrow array; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        if not odd.any():
            return self._gather(*self._cut(texts))
        plain, sizes = self._gather(*self._cut(texts.filter(pa.array(~odd))))
        own = [self._odd(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        out = np.empty(len(texts), np.int64)
        out[~odd], out[odd] = sizes, [len(x) for x in own]
        ids = np.empty(int(out.sum()), self.dtype)
        kept = np.repeat(~odd, out)
        ids[kept] = plain
        if len(own):
            ids[~kept] = np.concatenate(own)
        return ids, out

    def _cut(self, texts):
        """Units and their bounds. The first of a text is marked: no space precedes it."""
        marked = pc.binary_join_element_wise("\0", texts, "")
        marked = pc.replace_substring_regex(marked, _LINE, "\\1 \0\n \0\\2")
        marked = pc.replace_substring_regex(marked, _SIGN, "\\1 \0\\2\\3")
        lists = pc.split_pattern(marked, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        return lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()

    def _odd(self, text):
        """Ids of a text with runs of spaces, null characters or special tokens, in Python."""
        codes = []
        for part in self.parted.split(text) if self.parted else [text]:
            if part in self.special:
                codes.append(self.special[part])
            elif "\0" in part:
                codes += self._codes(["\0" + part])
            elif part:
                units = [u[1:] if u[0] == " " else "\0" + u for u in _CUT.split(part)]
                codes += self._codes(units)
        return np.frombuffer(b"".join(codes), self.dtype)

    def _gather(self, units, bounds):
        numbered = units.dictionary_encode()
        codes = self._codes(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        held = pa.array(codes, pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1)
        length = np.diff(offsets) // self.dtype.itemsize
        before = np.concatenate([[0], np.cumsum(length[np.asarray(numbered.indices)])])
        ids = np.empty(before[-1], self.dtype)
        for lo in range(0, len(units), GATHER):
            some = numbered.indices.slice(lo, GATHER)
            taken = held.take(some).buffers()[2]
            n = before[lo + len(some)] - before[lo]
            ids[before[lo] : before[lo] + n] = np.frombuffer(taken, self.dtype, n)
        return ids, np.diff(before[bounds])

    def _codes(self, units):
        """Id bytes of each unit; new ones are encoded and kept."""
        cache, older = self.cache, self.older
        if len(cache) >= CACHE_LIMIT:
            older = self.older = cache
            cache = self.cache = {}
        codes = list(map(cache.get, units))
        absent = [i for i, code in enumerate(codes) if code is None]
        if not absent:
            return codes
        missing = [units[i] for i in absent]
        if older:
            cache.update((u, code) for u in missing if (code := older.get(u)) is not None)
        new = [u for u in missing if u not in cache]
        if new:
            self._add(new)
        for i, unit in zip(absent, missing):
            codes[i] = cache[unit]
        for unit in new:
            if len(unit) > UNIT_LIMIT or "\n" in unit:
                del cache[unit]
        return codes

    def _parts(self, unit):
        """Keys whose ids in a row are the unit's; the unit itself if it is no plain text."""
        body = unit[1:] if unit[:1] == "\0" else unit
        parts = _PARTS.findall(body)
        if (
            len(parts) < 2
            or parts[0] == "\n"
            or "\n\n" in body
            or sum(map(len, parts)) != len(body)
            or not (body.isascii() or all([p.isalpha() or p.isascii() for p in parts]))
        ):
            return [unit]
        first = parts[0] if body is unit else "\0" + parts[0]
        return [first, *["\0" + p for p in parts[1:]]]

    def _add(self, units):
        cache, older, joined = self.cache, self.older, {}
        words, firsts, others = set(), set(), set()

        def add(unit):
            if unit.isalpha():
                words.add(unit)
            elif unit[:1] == "\0" and unit[1:].isalpha():
                firsts.add(unit)
            else:
                others.add(unit)

        for unit in units:
            if unit.isalpha():
                words.add(unit)
                continue
            parts = self._parts(unit)
            if len(parts) > 1:
                joined[unit] = parts
                for part in parts:
                    if part in older:
                        cache[part] = older[part]
            for part in parts:
                if part not in cache:
                    add(part)
        for kind, encode in ((words, self._add_words), (firsts, self._add_firsts)):
            held = list(kind)
            for at in range(0, len(held), 4096):
                some = held[at : at + 4096]
                if not encode(some):
                    others.update(some)
        others, code = list(others), self.code
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            raw = [u[1:] if u[:1] == "\0" else " " + u for u in some]
            found = self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)
            cache.update((unit, array(code, e.ids).tobytes()) for unit, e in zip(some, found))
        for unit, parts in joined.items():
            cache[unit] = b"".join([cache[p] for p in parts])

    def _add_words(self, words):
        """Encode plain words as one text, cut where the vocabulary marks words' bounds.

        False if the marks are not one a word; then the words are encoded one by one.
        """
        text = " " + " ".join(words)
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.dtype)
        marks = np.flatnonzero(self.bound[ids])
        if len(marks) != len(words):
            return False
        cuts = np.append(0, marks + 1) if self.by_end else np.append(marks, len(ids))
        raw, at = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        self.cache.update((w, raw[i:j]) for w, i, j in zip(words, at, at[1:]))
        return True


    def _add_firsts(self, units):
        """Encode words without a space before them as the lines of one text.

        Where spaces and lines' ends leave no ids, such a word is like any other.
        """
        if self.by_end:
            words = [u[1:] for u in units]
            if not self._add_words(words):
                return False
            self.cache.update((u, self.cache[w]) for u, w in zip(units, words))
            return True
        text = "\n".join(["", *(u[1:] for u in units)])
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.dtype)
        marks = np.flatnonzero(ids == ids[0])
        if len(marks) != len(units):
            return False
        raw, size = ids.tobytes(), self.dtype.itemsize
        ends = np.append(marks[1:], len(ids)) * size
        starts = (marks + 1) * size
        self.cache.update((u, raw[i:j]) for u, i, j in zip(units, starts.tolist(), ends.tolist()))
        return True


def with_ends(ids, sizes, end):
    """Ids and sizes with one end id behind every text."""
    ends = np.cumsum(sizes) + np.arange(len(sizes))
    out = np.empty(len(ids) + len(sizes), ids.dtype)
    text = np.ones(len(out), bool)
    text[ends] = False
    out[text], out[ends] = ids, end
    return out, sizes + 1


def crc32_of_ids(ids):
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def slices(batch, chars=1_500_000, column="text"):
    """Row ranges of about so many characters, to bound a step's memory."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > chars:
            yield start, i
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield start, len(sizes)
