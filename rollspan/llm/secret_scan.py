"""Secret scan over a trigram inverted index.

1. `build_index` cuts the texts of each task into blocks and writes one posting list per
   block and trigram: the numbers of the block's texts that hold it, as deltas of one or
   two bytes. The table is sorted by trigram, so a reader of a few trigrams skips the
   rest. Under the code KEYS a block keeps its texts' content keys.
2. Every rule's regular expression gives a Boolean trigram query (`trigram_query`).
   `candidates` reads the postings of the trigrams that all rules name, intersects and
   unites them per block, and turns the numbers left into content keys.
3. `scan` verifies: candidate texts meet the rules they are candidates of, and rules
   without a mandatory trigram search every text.

A text is known by its content key (two 64-bit hashes), so the index serves every table
of texts that it was built over and any rules, and no text is shuffled unless it is a
candidate. A text that the index has not seen meets only rules that search every text.

Spans are leftmost, non-overlapping per rule, in code points with the end exclusive;
matches that fail the rule's least length are dropped. Null texts count as empty. Each
row is judged by its own text: repeated rows, repeated and null doc_ids stay rows of
their own. Other columns pass through; one that is already called `spans` is replaced.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspan.llm import trigram_query as tq
from rollspan.llm.keys import content_key
from rollspan.session import cut

BLOCK_TEXTS = 4096  # less than 2^14, so a delta fits two bytes
BLOCK_BYTES = 8_000_000
STEP = 2_000_000  # bytes whose trigrams are found at a time
KEYS = -1
BROADCAST_KEYS = 1_000_000
POSTINGS = "block string, trigram int, docs binary"
FOUND = "array<struct<kind: string, start: long, end: long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0

    def query(self):
        return tq.trigram_query(self.pattern, self.flags)


# The base rules. A run of 16 or more hex digits starts at the first place with 16 of
# them in a row, so the bound stands in the pattern and prose gives no short matches.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        group=2,
        least=12,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}"),
)
# How issuers write their keys, and the frames of key files and tokens.
MORE = (
    Rule("github", r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{16,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"\bBearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"://[^\s:@/]{1,64}:[^\s:@/]{1,64}@"),
)
RULES = BASE + MORE


def distinct_trigrams(data, bounds, stamp):
    """(text number, code) of every distinct trigram of each text; data are folded bytes.

    `stamp` has a place per code. Texts longer than STEP are taken in overlapping steps.
    """
    numbers, codes = [], []
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        parts = []
        for at in range(lo, max(lo + 1, hi - 2), STEP):
            raw = data[at : min(hi, at + STEP + 2)]
            if len(raw) < 3:
                continue
            c = raw[:-2] << 14
            c |= raw[1:-1] << 7
            c |= raw[2:]
            order = np.arange(len(c), dtype=np.int32)
            stamp[c] = order
            parts.append(c[stamp[c] == order])
        if parts:
            own = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            codes.append(own)
            numbers.append(np.full(len(own), i, np.uint16))
    if not codes:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    return np.concatenate(numbers), np.concatenate(codes)


def packed(numbers, starts):
    """Delta bytes of ascending numbers below 2^14 in runs; returns (bytes, run bounds)."""
    delta = np.diff(numbers.astype(np.int32), prepend=0)
    delta[starts] = numbers[starts]
    wide = delta >= 128
    place = np.cumsum(1 + wide) - 1  # of each delta's last byte
    out = np.empty(len(delta) + int(wide.sum()), np.uint8)
    out[place] = delta & 127
    out[place[wide] - 1] = 128 | delta[wide] >> 7
    ends = np.append(starts[1:], len(numbers)) - 1
    return out, np.append(0, place[ends] + 1) if len(ends) else np.zeros(1, np.int64)


def unpacked(raw):
    """The numbers of one posting list."""
    raw = np.frombuffer(raw, np.uint8)
    last = raw < 128
    value = raw[last].astype(np.int64)
    ends = np.flatnonzero(last)
    wide = (ends > 0) & ~last[ends - 1]
    value[wide] += (raw[ends[wide] - 1].astype(np.int64) & 127) << 7
    return np.cumsum(value).astype(np.uint16)


def _blocks(batches):
    """Lists of batch slices of at most BLOCK_TEXTS texts and about BLOCK_BYTES."""
    held, texts, size = [], 0, 0
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column("t")).cast(pa.int64()))
        lo = 0
        for i, length in enumerate(lengths.tolist()):
            if texts and (texts == BLOCK_TEXTS or size + length > BLOCK_BYTES):
                held.append(batch.slice(lo, i - lo))
                yield held
                held, texts, size, lo = [], 0, 0, i
            texts, size = texts + 1, size + length
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield held


def _postings(batches):
    import uuid

    stamp = np.zeros(tq.CODES, np.int32)
    task = uuid.uuid4().hex[:12]
    for nth, held in enumerate(_blocks(batches)):
        numbers, codes, base = [], [], 0
        for part in held:
            column = part.column("t")
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            n, c = distinct_trigrams(tq.FOLD[raw], (bounds - bounds[0]).tolist(), stamp)
            numbers.append(n + np.uint16(base))
            codes.append(c)
            base += len(column)
        numbers, codes = np.concatenate(numbers), np.concatenate(codes)
        both = codes.astype(np.int64) << 14 | numbers
        both.sort()
        numbers, codes = both & (1 << 14) - 1, both >> 14
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        raw, bounds = packed(numbers, starts)
        keys = np.concatenate(
            [np.stack([np.asarray(p.column(k)) for k in ("k1", "k2")], axis=1) for p in held]
        )
        names = pa.array([f"{task}-{nth}"], pa.string())
        yield pa.RecordBatch.from_arrays(
            [names, pa.array([KEYS], pa.int32()), pa.array([keys.tobytes()], pa.binary())],
            names=["block", "trigram", "docs"],
        )
        lists = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]
        )
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(np.zeros(len(starts), np.int32))),
                pa.array(codes[starts].astype(np.int32)),
                lists,
            ],
            names=["block", "trigram", "docs"],
        )


def build_index(docs, text="text"):
    """The written postings of all texts: block, trigram, docs; sorted by trigram."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *content_key(F.col(text)))
    postings = rows.filter("t <> ''").mapInArrow(_postings, POSTINGS)
    return cut(postings.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block"))


def _evaluated(queries):
    def run(key, table):
        postings, keys = {}, None
        for code, raw in zip(table.column("trigram").to_pylist(), table.column("docs").to_pylist()):
            if code == KEYS:
                keys = np.frombuffer(raw, np.int64).reshape(-1, 2)
            else:
                postings[code] = unpacked(raw)
        everything = np.arange(len(keys), dtype=np.uint16)
        rules = np.zeros(len(keys), np.int64)
        for i, query in queries:
            rules[tq.evaluate(query, postings, everything)] |= 1 << i
        some = np.flatnonzero(rules)
        return pa.table(
            {"k1": keys[some, 0], "k2": keys[some, 1], "rules": rules[some]},
        )

    return run


def candidates(index, rules=RULES):
    """k1, k2 and the bits of the rules whose query holds, for every text with one."""
    if len(rules) > 62:
        raise ValueError("at most 62 rules a scan")
    queries = [(i, q) for i, q in ((i, r.query()) for i, r in enumerate(rules)) if q != tq.ANY]
    codes = set().union(*[tq.codes_of(q) for _, q in queries])
    named = index.filter(F.col("trigram").isin(KEYS, *sorted(codes)))
    found = named.groupBy("block").applyInArrow(_evaluated(queries), "k1 long, k2 long, rules long")
    return cut(found.dropDuplicates(["k1", "k2"]))


def spans_of(text, rules):
    """(kind, start, end) of the rules' matches, by start, then in the rules' order."""
    found = []
    for nth, (kind, compiled, group, least) in rules:
        for m in compiled.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), nth, kind, m.end()))
    found.sort()
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in found]


def _compiled(rules):
    return [(i, (r.kind, re.compile(r.pattern, r.flags), r.group, r.least)) for i, r in rules]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _search_all(rules, place, columns):
    """Spans of the given rules in every text; the text column is not passed on."""

    def run(batches):
        compiled = _compiled(rules)
        for batch in batches:
            spans = [spans_of(t, compiled) if t else [] for t in batch.column(place).to_pylist()]
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, _SPANS)], names=columns)

    return run


def _verify(rules):
    """Spans in a candidate of the rules that it is a candidate of."""

    def run(batches):
        compiled = _compiled(enumerate(rules))
        for batch in batches:
            spans = []
            for text, bits in zip(batch.column("t").to_pylist(), batch.column("rules").to_pylist()):
                spans.append(spans_of(text, [c for c in compiled if bits >> c[0] & 1]))
            some = pa.array([len(s) > 0 for s in spans], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(spans, _SPANS)], names=["k1", "k2", "found"]
            ).filter(some)

    return run


def _few(df):
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def scan(docs, index=None, rules=RULES, text="text"):
    """All columns of docs but the text, and `spans`: array of (kind, start, end).

    Without an index one is built of the same texts.
    """
    index = build_index(docs, text) if index is None else index
    rules = tuple(rules)
    free = [(i, r) for i, r in enumerate(rules) if r.query() == tq.ANY]
    narrowed = candidates(index, rules)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *content_key(F.col(text)))
    met = texts.join(_few(narrowed), ["k1", "k2"]).select("k1", "k2", "t", "rules")
    verified = met.mapInArrow(_verify(rules), f"k1 long, k2 long, found {FOUND}")
    found = cut(verified.groupBy("k1", "k2").agg(F.first("found").alias("found")))

    passed = [c for c in docs.columns if c not in (text, "spans")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"),
        *content_key(F.col(text)),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    names = ["row", "k1", "k2", "free"]
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "t"] + [T.StructField("free", T._parse_datatype_string(FOUND))]
    )
    searched = rows.mapInArrow(_search_all(free, 3, names), schema)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    merged = F.array_sort(
        F.transform(
            F.concat("free", F.coalesce("found", F.array().cast(FOUND))),
            lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    spans = F.transform(merged, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return searched.join(_few(found), ["k1", "k2"], "left").select("row.*", spans.alias("spans"))


def joined(spans):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned):
    """doc_id, counts of the base kinds, hash of the base spans, and all spans as text."""
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
