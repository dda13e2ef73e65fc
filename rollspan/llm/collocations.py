"""Phrase collocations by the stripes pattern.

A stripe is keyed by (lang, prefix) and counts the next words of the prefix. One level
per prefix length, 1 to `longest` - 1:

1. A task splits whole texts into pieces and words, counts the stripes of a run of
   tokens at once and writes those of a bucket of prefixes as one row.
2. The rows of a bucket come together and its stripes are merged elementwise.
   Extensions (a phrase's count is its entry in its prefix's stripe), prefix totals (the
   same entry, when the phrase is a prefix itself) and subsumption maxima (the largest
   entry, and the largest entry over stripes whose prefix begins one word earlier) are
   read off the merged stripes.
3. A phrase of `least` occurrences has only parts with as many. So the next level keys
   stripes by prefixes in the *size table* of this level and names a next word only if
   the phrase without its first word is in there. The size table maps the hash of a
   frequent phrase to the power of two below its count; a clash of hashes only lets
   through more, and counts are exact whatever it says. It lies in the shared folder in
   parts that tasks map into memory.

There are as many buckets as keep one near CAP occurrences on average, and a prefix
counted more than CAP times has its stripe cut into segments by the next word, as many
as its size in the table asks for, so what is merged at once stays small. Phrases that lie inside longer ones are found one word
at a time: if a longer phrase is as frequent, so is every phrase between the two.

Text: A-Z is lower-cased; pieces end at any of .,;:!? and \\n \\v \\f \\r; words are runs other
than space and tab. A null text is empty, a null lang is `und`. Repeated rows count as
often as they stand there; doc_ids are not used. Counts are long, products decimal.
Extra columns are ignored; an empty table gives no rows.
"""

import functools
import itertools
import uuid
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.llm.files import mapped, new_folder, open_output
from rollspan.session import cut

TOKENS = 1_500_000  # of a run
STEP = 4_000_000  # bytes of a text cut into words at once
CAP = 1 << 18
PART_SLOTS = 1 << 22
SALTS = 64
BROADCAST_LANGS = 100_000
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")

STRIPES = "lang string, bucket long, prefixes string, sizes binary, next string, counts binary"
MERGED = "lang string, prefix string, next array<string>, counts array<long>"


def _pieces(text):
    """The words of a text in runs of whole pieces; every piece ends with the word b"."."""
    raw = text.encode().lower().translate(_MARKS)
    lo = 0
    while lo < len(raw):
        hi = len(raw)
        if hi - lo > STEP:
            at = raw.rfind(b".", lo, lo + STEP)
            at = raw.find(b".", lo + STEP) if at < 0 else at
            hi = hi if at < 0 else at + 1
        words = raw[lo:hi].replace(b".", b" . ").split()
        words.append(b".")
        yield words
        lo = hi


class _Run:
    """Tokens as numbers: `code` 0 ends a piece, the others stand for (lang, word)."""

    def __init__(self):
        self.numbers, self.codes = {}, array("i")
        self.count = itertools.count(1)

    def add(self, lang, words):
        known = self.numbers.get(lang)
        if known is None:
            known = self.numbers[lang] = defaultdict(self.count.__next__, {b".": 0})
        self.codes.extend(map(known.__getitem__, words))

    def close(self):
        """Fix the codes, and the word and the lang of each."""
        n = next(self.count)
        self.code = np.frombuffer(self.codes, np.int32).astype(np.int64)
        self.words, self.lang, self.langs = [b""] * n, [0] * n, list(self.numbers)
        for i, known in enumerate(self.numbers.values()):
            for word, c in known.items():
                if c:
                    self.words[c], self.lang[c] = word, i
        del self.numbers, self.codes
        return self

    def hashes(self):
        """A hash of (lang, word) for every code."""
        import xxhash

        seeds = [xxhash.xxh64_intdigest(lang) for lang in self.langs]
        out = [xxhash.xxh64_intdigest(w, seeds[l]) for w, l in zip(self.words, self.lang)]
        return np.array(out, np.uint64)


def _runs(batches):
    run = _Run()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for words in _pieces(text):
                run.add(lang, words)
                if len(run.codes) >= TOKENS:
                    yield run.close()
                    run = _Run()
    if len(run.codes):
        yield run.close()


def _roll(h, following):
    """The hash of a phrase with one more word."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + following
    return h ^ (h >> np.uint64(32))


class Sizes:
    """The size table of one level: 0 if a hash belongs to no frequent phrase."""

    def __init__(self, folder, names, bits):
        self.bits = bits
        slots = min(1 << bits, PART_SLOTS)
        self.parts = {
            int(n.split("-")[1]): mapped(folder, n, np.uint8, slots) for n in names
        }

    def __call__(self, h):
        slot = h >> np.uint64(64 - self.bits)
        if self.bits <= PART_SLOTS.bit_length() - 1:
            return self.parts[0][slot] if self.parts else np.zeros(len(h), np.uint8)
        part = (slot // np.uint64(PART_SLOTS)).astype(np.int64)
        slot = slot % np.uint64(PART_SLOTS)
        out = np.zeros(len(h), np.uint8)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            some = order[lo:hi]
            held = self.parts.get(int(part[some[0]]))
            if held is not None:
                out[some] = held[slot[some]]
        return out


def _count_words(batches):
    for r in _runs(batches):
        counts = np.bincount(r.code, minlength=len(r.words))[1:]
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [r.langs[i] for i in r.lang[1:]],
                "word": [w.decode() for w in r.words[1:]],
                "n": counts,
            }
        )


def _segments(size):
    """How many segments a stripe of a prefix of this size code has."""
    return np.left_shift(1, np.maximum(size.astype(np.int64) - CAP.bit_length(), 0))


def _stripes(length, tables, buckets):
    """Stripes of the prefixes of `length` words; `tables` are (folder, names, bits) per level."""

    def run(batches):
        sizes = [Sizes(*t) for t in tables]
        for r in _runs(batches):
            code, words = r.code, r.hashes()
            at = np.flatnonzero(code)  # places where a phrase of `level` frequent words starts
            h = words[code[at]]
            size = sizes[0](h)
            at, h, size = at[size > 0], h[size > 0], size[size > 0]
            key = code[at]
            for level in range(1, length):
                at, h, size, key = _longer(level, at, h, key, code, words, sizes[level])
            # A phrase counts if the one without its first word is frequent too.
            named = _starts(code, at)[at + 1]
            at, h, size, key = at[named], h[named], size[named], key[named]
            if len(at):
                yield _as_rows(r, length, at, h, key, size, code[at + length], buckets)

    return run


def _starts(code, at):
    """A flag per place, one longer than the code."""
    flags = np.zeros(len(code) + 1, bool)
    flags[at] = True
    return flags


def _longer(level, at, h, key, code, words, table):
    """Places, hashes, sizes and exact numbers of the phrases one word longer."""
    both = _starts(code, at)[at + 1]
    at, h, key = at[both], h[both], key[both]
    last = code[at + level]
    h = _roll(h, words[last])
    size = table(h)
    kept = size > 0
    at, h, size = at[kept], h[kept], size[kept]
    pair = key[kept] * np.int64(len(words)) + last[kept]
    return at, h, size, np.unique(pair, return_inverse=True)[1].astype(np.int64)


def _gathered(bounds, order):
    """The places of the runs between `bounds`, taken in another order, and their bounds."""
    runs = np.diff(bounds)[order]
    ends = np.cumsum(runs)
    return np.repeat(bounds[:-1][order] - ends + runs, runs) + np.arange(ends[-1]), np.append(0, ends)


def _binary(values, bounds):
    """32-bit values between bounds as one binary value each."""
    raw = np.ascontiguousarray(values, np.int32)
    at = np.asarray(bounds * 4, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _as_rows(r, length, at, h, key, size, follower, buckets):
    """The stripes of a run: one row for each lang and bucket of prefixes."""
    import zlib

    segments = _segments(size)
    segment = np.zeros(len(at), np.int64)
    hot = np.flatnonzero(segments > 1)
    if len(hot):
        marks = np.array([zlib.crc32(w) for w in r.words], np.int64)
        segment[hot] = marks[follower[hot]] % segments[hot]
    most, width = segment.max() + 1, np.int64(len(r.words))
    entry, counts = np.unique((key * most + segment) * width + follower, return_counts=True)
    stripe = entry // width
    starts = np.flatnonzero(np.diff(stripe, prepend=-1))
    held = np.empty(key.max() + 1, np.int64)
    held[key] = np.arange(len(key))  # one place of each prefix
    one = held[stripe[starts] // most]
    place, mark = r.code[at[one]], h[one] + (stripe[starts] % most).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (_roll(mark, np.uint64(1)) >> np.uint64(1)).astype(np.int64) % buckets
    lang = np.array(r.lang)[place]
    order = np.lexsort((bucket, lang))
    entries, bounds = _gathered(np.append(starts, len(entry)), order)
    lang, bucket = lang[order], bucket[order]
    first = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    groups = np.append(first, len(order))
    names = pa.array([w.decode() for w in r.words], pa.string())
    begin = at[one][order]
    phrases = pc.binary_join_element_wise(*[names.take(pa.array(r.code[begin + k])) for k in range(length)], " ")
    joined = lambda values, ends, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), by)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(r.langs, pa.string()).take(pa.array(lang[first])),
            pa.array(bucket[first]),
            joined(phrases, groups, "\n"),
            _binary(np.diff(bounds), groups),
            joined(names.take(pa.array((entry % width)[entries])), bounds[groups], " "),
            _binary(counts[entries], bounds[groups]),
        ],
        names=[f.split()[0] for f in STRIPES.split(", ")],
    )


def _merged(lang, rows, least):
    """The stripes of one lang and bucket, merged elementwise; frequent entries stay."""
    whole = pa.Table.from_batches(rows).combine_chunks()
    words = lambda c, by: pc.split_pattern(whole.column(c), by).combine_chunks().flatten().dictionary_encode()
    numbers = lambda c: np.frombuffer(b"".join(whole.column(c).to_pylist()), np.int32)
    prefixes, following = words("prefixes", "\n"), words("next", " ")
    prefix = np.repeat(np.asarray(prefixes.indices).astype(np.int64), numbers("sizes"))
    pair, at = np.unique(prefix << 32 | np.asarray(following.indices), return_inverse=True)
    counts = np.bincount(at, weights=numbers("counts")).astype(np.int64)  # below 2^53
    pair, counts = pair[counts >= least], counts[counts >= least]
    if not len(pair):
        return None
    starts = np.flatnonzero(np.diff(pair >> 32, prepend=-1))
    ends = pa.array(np.append(starts, len(pair)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(starts), pa.string()),
            prefixes.dictionary.take(pa.array(pair[starts] >> 32)),
            pa.ListArray.from_arrays(ends, following.dictionary.take(pa.array(pair & 0xFFFFFFFF))),
            pa.ListArray.from_arrays(ends, pa.array(counts)),
        ],
        names=["lang", "prefix", "next", "counts"],
    )


def _merge(least):
    """Merge the rows of each bucket; they follow each other in the partition."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("bucket").to_pylist()))
            lo = 0
            for i, new in enumerate(keys):
                if new != key:
                    if i > lo:
                        held.append(batch.slice(lo, i - lo))
                    if held:
                        found = _merged(key[0], held, least)
                        if found is not None:
                            yield found
                    key, held, lo = new, [], i
            held.append(batch.slice(lo))
        if held:
            found = _merged(key[0], held, least)
            if found is not None:
                yield found

    return run


def _phrase_hash(lang, words):
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    h = np.array([xxhash.xxh64_intdigest(words[0], seed)], np.uint64)
    for word in words[1:]:
        h = _roll(h, np.array([xxhash.xxh64_intdigest(word, seed)], np.uint64))
    return int(h[0])


def _slots(bits):
    def run(batches):
        for batch in batches:
            h = [
                _phrase_hash(lang, phrase.encode().split(b" "))
                for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            ]
            slot = np.array(h, np.uint64) >> np.uint64(64 - bits)
            size = 1 + np.floor(np.log2(np.maximum(np.asarray(batch.column("f")), 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((slot // np.uint64(PART_SLOTS)).astype(np.int32)),
                    pa.array((slot % np.uint64(PART_SLOTS)).astype(np.int32)),
                    pa.array(size),
                ],
                names=["part", "slot", "size"],
            )

    return run


def _store_parts(folder, slots):
    """Write each part of a size table; its rows come together, sorted by part."""

    def write(part, table):
        name = f"part-{part}-{uuid.uuid4().hex}"
        with open_output(folder, name) as stream:
            stream.write(table.tobytes())
        return pa.RecordBatch.from_pydict({"name": [name]})

    def run(batches):
        held, table = None, None
        for batch in batches:
            parts, slot, size = (np.asarray(batch.column(c)) for c in ("part", "slot", "size"))
            for part in np.unique(parts).tolist():
                if part != held:
                    if held is not None:
                        yield write(held, table)
                    held, table = part, np.zeros(slots, np.uint8)
                some = parts == part
                np.maximum.at(table, slot[some], size[some].astype(np.uint8))
        if held is not None:
            yield write(held, table)

    return run


def size_table(frequent):
    """(folder, part names, bits) of a written table of lang, phrase and count f."""
    folder = new_folder(frequent.sparkSession)
    count = frequent.count()
    bits = max(16, int(16 * count).bit_length())
    slots = min(1 << bits, PART_SLOTS)
    rows = frequent.mapInArrow(_slots(bits), "part int, slot int, size int")
    parts = rows.repartition(max(1, (1 << bits) // PART_SLOTS), "part").sortWithinPartitions("part")
    names = parts.mapInArrow(_store_parts(folder, slots), "name string").collect()
    return folder, sorted(r["name"] for r in names), bits


def count_stripes(docs, least=100, longest=5):
    """(word counts, [merged stripes per prefix length]), as written tables."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("text <> ''")
    words = cut(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    tables = [size_table(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))]
    levels, key = [], ["lang", "bucket"]
    buckets = 1 + (words.agg(F.sum("n")).first()[0] or 0) // CAP
    for length in range(1, longest):
        found = rows.mapInArrow(_stripes(length, tables, buckets), STRIPES)
        merged = cut(found.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge(least), MERGED))
        levels.append(merged)
        if length < longest - 1:
            tables.append(size_table(entries(merged).select("lang", "phrase", "f")))
    return words, levels


def entries(stripes):
    """lang, prefix, word, phrase and f of every frequent extension in merged stripes."""
    flat = stripes.select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("e"))
    return flat.select(
        "lang",
        "prefix",
        F.col("e.next").alias("word"),
        F.concat_ws(" ", "prefix", "e.next").alias("phrase"),
        F.col("e.counts").alias("f"),
    )


def _all(tables):
    return functools.reduce(lambda a, b: a.unionByName(b), tables)


def totals(words, levels):
    """lang, phrase and count f of every word and frequent prefix."""
    single = words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    return _all([single, *[entries(s).select("lang", "phrase", "f") for s in levels[:-1]]])


def unsubsumed(levels):
    """lang, phrase and count a of the phrases that no longer one equals in count."""
    found = [entries(s) for s in levels]
    phrases = _all([e.select("lang", "phrase", F.col("f").alias("a")) for e in found])
    if len(levels) == 1:
        return phrases
    shorter = [F.col("prefix"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")]
    maxima = _all(
        [
            e.groupBy("lang", part.alias("phrase")).agg(F.max("f").alias("m"))
            for e in found[1:]
            for part in shorter
        ]
    )
    maxima = maxima.groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    return phrases.join(maxima, ["lang", "phrase"], "left").filter("m is null or m < a").select("lang", "phrase", "a")


def collocations(docs, least=100, longest=5, first=2000):
    """lang, rank, phrase, a, l, r, n, score: each lang's `first` best phrases."""
    words, levels = count_stripes(docs, least, longest)
    n = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    free, counts = cut(unsubsumed(levels)), cut(totals(words.filter(F.col("n") >= least), levels))
    parts = F.split("phrase", " ", -1)
    cuts = free.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"), parts.alias("w")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"),
    )
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(F.broadcast(n) if n.count() <= BROADCAST_LANGS else n, "lang")
        .withColumn("score", F.expr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    )
    worst = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a").agg(worst).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.n").alias("n"), F.col("cut.score").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= first).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
