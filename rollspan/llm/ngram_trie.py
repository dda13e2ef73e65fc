"""A bigram model in Elias-Fano trie files, and log10 scores of whole texts.

Level 1 holds the words of the training texts: their hashes in order (a word's place is
its id), and counts. Level 2 holds the successors of every context: per context a
sorted run of word ids, made one monotone sequence by adding the last value of the run
before, with monotone pointers to the runs; both are Elias-Fano coded. Beside each
successor lies its smoothed log10 probability and beside each context its back-off
weight, in 16-bit steps. A query looks up the context's place, reads its run's bounds
and base, and searches the successor relative to that base.

The model interpolates: P(w | u) = max(c(u w) - D, 0) / c(u) + D n(u) / c(u) * P1(w), where
n(u) counts the different successors of u and P1 is the base (add-0.1) model; the
begin of a text is a context, its end a word. D = 0.75.

The levels are cut into shard files. Words are sharded by the upper bits of their hash,
successors by their context; a context with a large share of all tokens is dealt over
all shards by successor, and its back-off weight, then, comes from the sum over shards.
Counting passes combine in the task first and shuffle sorted runs of keys, one row a
task and shard. Files lie in the shared folder and are memory-mapped where they are read,
so a task holds no level in its heap. Words are told apart by 64-bit hashes.

Tokens: A-Z is lower-cased, words are runs other than space and \\t-\\r, then one end.
Null and empty texts are the end alone. Rows are scored one by one, repeated rows alike;
a null doc_id counts as held out. Without training rows every probability is the
base's. Extra columns are ignored; an empty table gives no rows.
"""

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm import elias_fano
from rollspan.llm.files import attempt_name, mapped, new_folder, open_input, open_output
from rollspan.llm.tokens import slices

DISCOUNT, ADD = 0.75, 0.1
STEPS, LEAST = 2048.0, -31.0  # 16-bit codes of log10 values: LEAST + code / STEPS
END = b" end"  # no word holds a space
BEGIN = b" begin"
HELD_WORDS = 400_000
RUN_TOKENS = 2_000_000
SCORED = (
    "doc_id long, n_tokens long, n_known long, base_score double, score double"
)


def held_out():
    """Rows kept from training: crc32 of the doc_id's text divisible by 10 (null is '')."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


def _hash(word):
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _words(text):
    return text.encode().lower().split() if text else []


def _shard_of(keys, shards):
    """Shard by the upper 32 bits, so shards in order are hashes in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _runs(keys, counts, shard, shards):
    """One row per shard that has keys: shard, sorted keys and their counts."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    held = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _, _ in held], pa.int32()),
            pa.array([keys[a:b].astype("<u8").tobytes() for _, a, b in held], pa.binary()),
            pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in held], pa.binary()),
        ],
        names=["shard", "keys", "counts"],
    )


def _merge(table):
    """Distinct sorted keys of all runs of a shard and their summed counts."""
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count_words(shards):
    """Partial word counts of a task, flushed when many distinct words are held."""

    def run(batches):
        from collections import Counter

        held = Counter()

        def flush():
            words = np.fromiter(map(_hash, held), np.uint64, len(held))
            counts = np.fromiter(held.values(), np.int64, len(held))
            return _runs(words, counts, _shard_of(words, shards), shards)

        for batch in batches:
            for lo, hi in slices(batch):
                for text in batch.column("text").slice(lo, hi - lo).to_pylist():
                    held.update(_words(text))
                    held[END] += 1
                if len(held) >= HELD_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


RUN = "shard int, keys binary, counts binary"


def _write_words(folder):
    def run(table):
        keys, counts = _merge(table)
        name = attempt_name("words", table.column("shard")[0].as_py())
        with open_output(folder, name) as out:
            out.write(keys.astype("<u8").tobytes())
            out.write(counts.astype("<i8").tobytes())
        return pa.Table.from_pydict(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "name": [name],
                "n": pa.array([len(keys)], pa.int64()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
            }
        )

    return run


class Vocabulary:
    """Memory-mapped level 1: ids and counts of word hashes."""

    def __init__(self, folder, model):
        self.shards = model["shards"]
        self.total, self.size = model["tokens"], model["words"]
        self.keys, self.counts = {}, {}
        self.bases = np.zeros(self.shards, np.int64)
        for s, name, n, base in model["word_files"]:
            self.keys[s] = mapped(folder, name, "<u8", n)
            self.counts[s] = mapped(folder, name, "<i8", n, 8 * n)
            self.bases[s] = base

    def lookup(self, hashes):
        """(id or -1, count or 0) of word hashes, in hash order of the shards."""
        order = np.argsort(hashes)
        keys = hashes[order]
        shard = _shard_of(keys, self.shards).astype(np.int64)
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
            own = self.keys.get(int(shard[lo]))
            if own is None:
                continue
            at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
            hit = own[at] == keys[lo:hi]
            ids[lo:hi] = np.where(hit, self.bases[shard[lo]] + at, -1)
            counts[lo:hi] = np.where(hit, self.counts[int(shard[lo])][at], 0)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids[back], counts[back]

    def base(self, counts):
        """log10 of the add-0.1 probabilities."""
        return np.log10((counts + ADD) / (self.total + ADD * (self.size + 1)))


class WordIds:
    """Bounded cache word -> (id, count) on top of the mapped vocabulary."""

    def __init__(self, vocabulary):
        self.vocabulary, self.index = vocabulary, {}
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin = self._one(BEGIN)

    def _one(self, word):
        return int(self.vocabulary.lookup(np.array([_hash(word)], np.uint64))[0][0])

    def __call__(self, texts):
        """(ids, counts, tokens per text); every text ends with the end token."""
        split = [_words(t) + [END] for t in texts]
        missing = set().union(*split).difference(self.index)
        if len(self.index) + len(missing) > HELD_WORDS:
            missing = set().union(*split)
            self.index, self.ids, self.counts = {}, self.ids[:0], self.counts[:0]
        if missing:
            words = list(missing)
            ids, counts = self.vocabulary.lookup(np.fromiter(map(_hash, words), np.uint64, len(words)))
            self.index.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        get, sizes = self.index.__getitem__, np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        return self.ids[at], self.counts[at], sizes


def _contexts(ids, sizes, begin):
    """The id before each token; the begin id (one past the words) at each text's start."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = begin
    return before


def _pair_shard(u, w, hot, shards):
    """Shard of a pair: by context, or by both where the context is hot."""
    mix = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        both = hot[at] == u
        mix = np.where(both, mix ^ (w.astype(np.uint64) + U1) * np.uint64(0xC2B2AE3D27D4EB4F), mix)
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((mix >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


U1 = np.uint64(1)
U32 = np.uint64(32)


def _key(u, w):
    return (u.astype(np.uint64) << U32) | w.astype(np.uint64)


def _count_pairs(folder, model):
    def run(batches):
        words, held, total = WordIds(Vocabulary(folder, model)), [], 0
        hot, shards = np.array(model["hot"], np.int64), model["shards"]

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            u, w = (keys >> U32).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return _runs(keys, counts, _pair_shard(u, w, hot, shards), shards)

        for batch in batches:
            for lo, hi in slices(batch):
                ids, _, sizes = words(batch.column("text").slice(lo, hi - lo).to_pylist())
                held.append(_key(_contexts(ids, sizes, model["begin"]), ids))
                total += len(ids)
                if total >= RUN_TOKENS:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


def _code(log10):
    return np.clip(np.floor((log10 - LEAST) * STEPS), 0, 65_535).astype("<u2")


def _value(code):
    return LEAST + code / STEPS


def _write_pairs(folder, model):
    """A shard's trie file: contexts, pointers, successors, their codes, back-off codes."""

    def run(table):
        shard = table.column("shard")[0].as_py()
        keys, counts = _merge(table)
        u, w = (keys >> U32).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        contexts, runs = u[first], np.diff(np.append(first, len(u)))
        vocabulary = Vocabulary(folder, model)
        p1 = 10.0 ** vocabulary.base(_counts_of(vocabulary, w))
        hot = np.isin(contexts, np.array(model["hot"], np.int64))
        own = _counts_of(vocabulary, contexts)
        own[contexts == model["begin"]] = model["texts"]
        sums = np.repeat(own, runs).astype(np.float64)
        weight = DISCOUNT * runs / own
        # A hot context's back-off weight is not known here; its codes hold the first term.
        back = np.where(np.repeat(hot, runs), 0.0, np.repeat(weight, runs)) * p1
        p = np.maximum(counts - DISCOUNT, 0) / sums + back
        base = np.concatenate([[0], np.cumsum(w[first[1:] - 1])]) if len(first) else first
        parts = [
            elias_fano.encode(contexts),
            elias_fano.encode(np.append(first, len(u))),
            elias_fano.encode(w + np.repeat(base, runs)),
        ]
        codes = [_code(np.log10(p)), _code(np.log10(weight))]
        name = attempt_name("pairs", shard)
        with open_output(folder, name) as out:
            out.write(np.array([*map(len, parts), len(u), len(contexts)], "<i8").tobytes())
            for part in parts:
                out.write(part.astype("<u8").tobytes())
            for code in codes:
                out.write(code.tobytes())
        ids = contexts[hot]
        return pa.Table.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "name": [name],
                "hot_ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
                "hot_runs": pa.array([runs[hot].tolist()], pa.list_(pa.int64())),
            }
        )

    return run


def _counts_of(vocabulary, ids):
    """Counts by word id (0 for the begin id)."""
    out = np.zeros(len(ids), np.int64)
    shards = sorted(vocabulary.keys)
    bases = np.array([vocabulary.bases[s] for s in shards])
    at = np.searchsorted(bases, ids, "right") - 1
    for k, s in enumerate(shards):
        own = np.flatnonzero((at == k) & (ids < vocabulary.size))
        if len(own):
            out[own] = vocabulary.counts[s][ids[own] - bases[k]]
    return out


class PairShard:
    """Memory-mapped reader of a shard's trie file."""

    def __init__(self, folder, name):
        head = [int(x) for x in mapped(folder, name, "<i8", 5)]
        at, parts = 40, []
        for size in head[:3]:
            parts.append(elias_fano.Sequence(mapped(folder, name, "<u8", size, at)))
            at += 8 * size
        self.contexts, self.pointers, self.successors = parts
        self.codes = mapped(folder, name, "<u2", head[3], at)
        self.back = mapped(folder, name, "<u2", head[4], at + 2 * head[3])

    def find(self, u, w):
        """(successor's log10 code value or nan, back-off log10 or nan) of pairs sorted by u."""
        n, m = len(u), self.contexts.n
        p, back = np.full(n, np.nan), np.full(n, np.nan)
        first = np.flatnonzero(np.diff(u, prepend=-1))
        place = self.contexts.successor(u[first].astype(np.uint64), np.zeros(len(first), np.int64), np.full(len(first), m))
        real = np.minimum(place, m - 1)
        known = (place < m) & (self.contexts.access(real).astype(np.int64) == u[first])
        begin, end = self.pointers.access(real).astype(np.int64), self.pointers.access(real + 1).astype(np.int64)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)), 0).astype(np.uint64)
        runs = np.diff(np.append(first, n))
        rows = np.flatnonzero(np.repeat(known, runs))
        if not len(rows):
            return p, back
        own = np.repeat(np.arange(len(first)), runs)[rows]
        back[rows] = _value(self.back[real[own]].astype(np.float64))
        target = base[own] + w[rows].astype(np.uint64)
        at = self.successors.successor(target, begin[own], end[own])
        inside = np.flatnonzero(at < end[own])
        hit = inside[self.successors.access(at[inside]) == target[inside]]
        p[rows[hit]] = _value(self.codes[at[hit]].astype(np.float64))
        return p, back


class Model:
    """The mapped model: log10 probabilities of token arrays."""

    def __init__(self, folder):
        with open_input(folder, "model.json") as stream:
            self.model = json.loads(stream.read())
        self.folder = folder
        self.vocabulary = Vocabulary(folder, self.model)
        self.words = WordIds(self.vocabulary)
        self.pairs = {}
        self.hot = np.array(self.model["hot"], np.int64)
        self.hot_back = np.array(self.model["hot_back"], np.float64)

    def _shard(self, s):
        if s not in self.pairs:
            name = self.model["pair_files"].get(str(s))
            self.pairs[s] = PairShard(self.folder, name) if name else None
        return self.pairs[s]

    def score(self, u, w, base):
        """log10 P(w | u); unknown contexts leave the base probability."""
        out = base.copy()
        rows = np.flatnonzero(u >= 0)
        known = np.where(w[rows] >= 0, w[rows], 0xFFFFFFFF)
        keys, back_at = np.unique(_key(u[rows], known), return_inverse=True)
        ku, kw = (keys >> U32).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p, back = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
        shard = _pair_shard(ku, kw, self.hot, self.model["shards"])
        order = np.argsort(shard.astype(np.uint16) if self.model["shards"] < 65_536 else shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model["shards"] + 1))
        for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = self._shard(s) if hi > lo else None
            if own is not None:
                some = order[lo:hi]
                p[some], back[some] = own.find(ku[some], kw[some])
        p, back, kb = p[back_at], back[back_at], base[rows]
        hot = np.zeros(len(rows), bool)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u[rows]), len(self.hot) - 1)
            hot = self.hot[at] == u[rows]
            back = np.where(hot, self.hot_back[at], back)
        off = np.where(np.isnan(back), kb, back + kb)
        found = ~np.isnan(p)
        plain = np.where(found, p, off)
        plain = np.where(found & hot, np.log10(10.0**p + 10.0**off), plain)
        out[rows] = np.minimum(plain, 0.0)
        return out


_MODELS = {}


def _model(folder):
    """The worker's mapped model; one at a time."""
    if folder not in _MODELS:
        _MODELS.clear()
        _MODELS[folder] = Model(folder)
    return _MODELS[folder]


def _score(folder):
    def run(batches):
        model = _model(folder)
        for batch in batches:
            for lo, hi in slices(batch, 4_000_000):
                part = batch.slice(lo, hi - lo)
                ids, counts, sizes = model.words(part.column("text").to_pylist())
                base = model.vocabulary.base(counts)
                u = _contexts(ids, sizes, model.model["begin"])
                score = model.score(u, ids, base)
                starts = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(score, starts)),
                    ],
                    names=[f.split()[0] for f in SCORED.split(", ")],
                )

    return run


def train(texts, shards=None):
    """Build the model's files from the texts of a table; returns the folder's URI."""
    spark = texts.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark)
    rows = texts.select(F.col("text").cast("string"))
    counted = rows.mapInArrow(_count_words(shards), RUN).groupBy("shard")
    files = counted.applyInArrow(
        _write_words(folder), "shard int, name string, n long, tokens long"
    ).collect()
    files.sort(key=lambda r: r["shard"])
    sizes = [r["n"] for r in files]
    bases = np.cumsum([0, *sizes])
    model = {
        "shards": shards,
        "words": int(sum(sizes)),
        "tokens": sum(r["tokens"] for r in files),
        "texts": rows.count(),
        "word_files": [(r["shard"], r["name"], r["n"], int(b)) for r, b in zip(files, bases)],
        "hot": [],
        "hot_back": [],
        "pair_files": {},
    }
    model["begin"] = model["words"]
    if model["words"] >= 2**32 - 1:
        raise ValueError("word ids need 32 bits")
    model["hot"] = _hot_words(spark, folder, model)
    pairs = rows.mapInArrow(_count_pairs(folder, model), RUN).groupBy("shard")
    built = pairs.applyInArrow(
        _write_pairs(folder, model),
        "shard int, name string, hot_ids array<long>, hot_runs array<long>",
    ).collect()
    model["pair_files"] = {str(r["shard"]): r["name"] for r in built}
    model["hot_back"] = _hot_weights(folder, model, built)
    with open_output(folder, "model.json") as out:
        out.write(json.dumps(model).encode())
    return folder


def _hot_words(spark, folder, model):
    """Ids of contexts with more than 1 / (4 shards) of all tokens: at most 4 shards + 1."""
    least = model["tokens"] / (4 * model["shards"])
    held = model["word_files"]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                _, name, n, base = held[k]
                counts = mapped(folder, name, "<i8", n, 8 * n)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > least) + base)], names=["id"])

    if not held:
        return []
    found = spark.range(0, len(held), 1, len(held)).mapInArrow(run, "id long").collect()
    ids = [r["id"] for r in found]
    return sorted(ids + [model["begin"]] * (model["texts"] > least))


def _hot_weights(folder, model, built):
    """log10 back-off weights of the hot contexts from their runs over all shards."""
    runs = dict.fromkeys(model["hot"], 0)
    for row in built:
        for u, n in zip(row["hot_ids"], row["hot_runs"]):
            runs[u] += n
    if not runs:
        return []
    ids = np.array(model["hot"], np.int64)
    own = _counts_of(Vocabulary(folder, model), ids).astype(np.float64)
    own[ids == model["begin"]] = model["texts"]
    n = np.array([max(runs[u], 1) for u in model["hot"]])
    return np.log10(DISCOUNT * n / own).tolist()


def score(docs, folder):
    """doc_id, token counts, base and model log10 scores of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(folder), SCORED)


def score_documents(docs):
    """Train on the rows that are not held out and score all rows."""
    folder = train(docs.select("doc_id", "text").filter(~held_out()))
    with open_input(folder, "model.json") as stream:
        tokens = json.loads(stream.read())["tokens"]
    return score(docs, folder).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
