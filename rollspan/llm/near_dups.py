"""MinHash near-duplicate groups: banding, signature check, exact check, components.

1. A task turns each whole text into its set of word shingles (64-bit hashes), a
   fingerprint of the set and 128 minima of universal hashes (a x + b mod 2^64, upper
   half). Equal sets become one node at once, whatever their doc_ids.
2. The minima form 32 bands of 4. At similarity 0.8 a pair of texts shares no band with
   probability (1 - 0.8^4)^32 < 5e-8.
3. In each bucket every node proposes itself to the bucket's smallest node; a node's
   proposal with most shared bands is checked first, by signature and then on the full
   sets. Confirmed links give components by large-star and small-star.
4. Buckets that still hold several components are searched in blocks: nodes outside the
   bucket's largest component meet all of its nodes inside a task, first by signature,
   then, for the nodes that may link, by full sets. So no link between components is
   lost, members of one group are not compared, and no pairs are written out.

The signature check passes pairs whose minima agree in 60 % or more; at similarity 0.8
fewer agree with a probability below 1e-7.

Text: A-Z is lower-cased; words are runs other than space and \\t-\\r. A text with fewer
words than the shingle width is one shingle; null and empty texts have no shingles and
link with nothing. Rows are judged by their own text: a doc_id with several texts has a
node for each. A component is named by the smallest doc_id in it; null ids take part and
name nothing, so a component of null ids has a null name and its rows are kept. Extra
columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm import worker
from rollspan.llm.components import star_components
from rollspan.llm.keys import content_key
from rollspan.llm.tokens import slices
from rollspan.session import cut

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
AGREE = 77  # of 128 minima
BLOCK = 1024  # nodes of a block, and
SET_BLOCK = 2_000_000  # shingles of a block
BROADCAST_IDS = 1_000_000
WORDS_KEPT = 300_000
_WORDS = {}

FEATURES = (
    "doc_id long, k1 long, k2 long, n_shingles long, fp1 long, fp2 long, signature binary, bands array<long>"
)


def _coefficients():
    random = np.random.default_rng(20_241)
    a = random.integers(1, 2**63, HASHES, np.uint64) | np.uint64(1)
    return a, random.integers(0, 2**63, HASHES, np.uint64)


def _mix(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts):
    """64-bit hashes of every text's words, each distinct word hashed once."""
    import xxhash

    split = [text.encode().lower().split() if text else [] for text in texts]
    missing = set()
    for words in split:
        missing.update(set(words).difference(_WORDS))
    if len(_WORDS) + len(missing) > WORDS_KEPT:
        _WORDS.clear()
        missing = set().union(*split)
    _WORDS.update((w, xxhash.xxh64_intdigest(w)) for w in missing)
    get = _WORDS.__getitem__
    return [np.fromiter(map(get, w), np.uint64, len(w)) for w in split]


def _forget():
    """Free a task's words: later stages use the same worker for other work."""
    _WORDS.clear()
    worker.release()


def shingle_set(words, width):
    """Sorted distinct hashes of the word shingles."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    joined = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
    return np.unique(_mix(joined))


def minima(shingles, a, b):
    """The smallest of each universal hash over a set, 32 bits each."""
    x, least = shingles >> np.uint64(32), None
    for lo in range(0, len(x), 512):
        h = np.multiply.outer(x[lo : lo + 512], a)
        h += b
        h = h.min(axis=0)
        least = h if least is None else np.minimum(least, h)
    return (least >> np.uint64(32)).astype("<u4")


def _band_keys(signature):
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _features(width):
    def run(batches):
        worker.enter("near_dups")
        a, b = _coefficients()
        for batch in batches:
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                rows = {"n": [], "fp1": [], "fp2": [], "sig": [], "bands": []}
                for words in word_hashes(part.column("text").to_pylist()):
                    s = shingle_set(words, width)
                    rows["n"].append(len(s))
                    rows["fp1"].append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    rows["fp2"].append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    sig = minima(s, a, b) if len(s) else None
                    rows["sig"].append(None if sig is None else sig.tobytes())
                    rows["bands"].append(None if sig is None else _band_keys(sig))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("doc_id", "k1", "k2")],
                        pa.array(rows["n"], pa.int64()),
                        pa.array(rows["fp1"], pa.int64()),
                        pa.array(rows["fp2"], pa.int64()),
                        pa.array(rows["sig"], pa.binary()),
                        pa.array(rows["bands"], pa.list_(pa.int64())),
                    ],
                    names=[f.split()[0] for f in FEATURES.split(", ")],
                )
        _forget()

    return run


def signatures(docs, width=5):
    """Written table of set size, set fingerprint, minima and band keys per row."""
    rows = docs.select(
        F.col("doc_id").cast("long"), *content_key(F.col("text")), F.col("text").cast("string")
    )
    return cut(rows.mapInArrow(_features(width), FEATURES))


def _agree(batches):
    """Keep pairs whose signatures agree in AGREE places or more."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), "<u4").reshape(-1, HASHES)
        y = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), "<u4").reshape(-1, HASHES)
        keep = (x == y).sum(axis=1) >= AGREE
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _check_signatures(pairs, nodes):
    side = nodes.select("id", "n_shingles", "signature")
    a = side.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a"))
    b = side.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b"))
    sized = (
        pairs.join(a, "a").join(b, "b")
        .filter(100 * F.least("n_a", "n_b") >= 80 * F.greatest("n_a", "n_b"))
        .select("a", "b", "sig_a", "sig_b")
    )
    return sized.mapInArrow(_agree, "a long, b long")


def _sets(width):
    def run(batches):
        worker.enter("near_dups")
        seen = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            new = [not (i in seen or seen.add(i)) for i in ids]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                sets = [
                    shingle_set(words, width).tobytes()
                    for words in word_hashes(part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sets, pa.binary())], names=["id", "set"]
                )
        _forget()

    return run


def _links(percent):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingle_sets(ids, nodes, docs, width):
    """Written table of the full shingle sets of these nodes, from the rows that stand for them.

    A task takes a repeated row once; repeats in several tasks are taken out if there are any.
    """
    wanted = nodes.select("id", "row.doc_id", "row.k1", "row.k2").join(ids, "id")
    few = ids.count() <= BROADCAST_IDS  # 32 bytes each
    wanted = (F.broadcast(wanted) if few else wanted).alias("w")
    rows = docs.select(
        F.col("doc_id").cast("long"), *content_key(F.col("text")), F.col("text").cast("string")
    ).alias("d")
    same = [F.col("d.k1") == F.col("w.k1"), F.col("d.k2") == F.col("w.k2"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))]
    met = rows.join(wanted, same[0] & same[1] & same[2]).select("w.id", "d.text")
    sets = cut(met.mapInArrow(_sets(width), "id long, set binary"))
    if sets.count() > ids.count():
        sets = cut(sets.dropDuplicates(["id"]))
    return sets


def _confirm(pairs, nodes, docs, width, percent):
    """Links among written pairs, by the full shingle sets of the texts they name."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _shingle_sets(ids, nodes, docs, width)
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return cut(both.mapInArrow(_links(percent), "a long, b long").distinct())


def _units(batches, found, schema):
    """Apply `found` to the rows of each unit of a partition sorted by its first column."""
    unit, held = None, []
    names = [f.split()[0] for f in schema.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)})

    for rows in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in rows.columns]):
            if row[0] != unit:
                out.extend(found(held) if held else ())
                unit, held = row[0], []
            held.append(row)
        if out:
            yield batch(out)
    out = list(found(held)) if held else []
    if out:
        yield batch(out)


MEMBER = "unit long, id long, component long, is_x boolean"
PAIR = "a long, b long"


def _may_link(batches):
    """The members of each unit that agree with one of another component there.

    A pair counts in the first band that it shares, so it is taken up in one bucket only.
    """

    def found(rows):
        x, y = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not x or not y:
            return
        sig = [np.frombuffer(b"".join(r[4] for r in side), "<u4").reshape(-1, HASHES) for side in (x, y)]
        size = np.array([r[5] for r in y])
        component, band = np.array([r[2] for r in y]), rows[0][6]
        taken = np.zeros(len(y), bool)
        for r, s in zip(x, sig[0]):
            fit = 100 * np.minimum(size, r[5]) >= 80 * np.maximum(size, r[5])
            near = np.flatnonzero(fit & (component != r[2]))
            same = sig[1][near] == s
            near_enough = same.sum(axis=1) >= AGREE
            earlier = same.reshape(-1, BANDS, ROWS).all(axis=2)[:, :band].any(axis=1)
            near = near[near_enough & ~earlier]
            if len(near):
                taken[near] = True
                yield r[:4]
        yield from (r[:4] for r, t in zip(y, taken) if t)

    return _units(batches, found, MEMBER)


def _exact(percent):
    """Confirmed links that join the components of a task's units, by full sets.

    A link between components that earlier links of the task join adds nothing to them
    and is left out, so a task gives fewer links than it meets components.
    """

    def run(batches):
        joined = {}

        def root(c):
            top = c
            while top in joined:
                top = joined[top]
            while c != top:
                joined[c], c = top, joined[c]
            return top

        def found(rows):
            x, y = [r for r in rows if r[3]], [r for r in rows if not r[3]]
            if not x or not y:
                return
            names, at_name = np.unique([r[2] for r in y], return_inverse=True)
            tops = lambda: np.array([root(int(c)) for c in names])[at_name]
            component = tops()
            if all(root(r[2]) == component[0] for r in x) and (component == component[0]).all():
                return
            sets = [np.frombuffer(r[4], "<u8") for r in y]
            size = np.array([len(s) for s in sets])
            keys, owner = np.concatenate(sets), np.repeat(np.arange(len(y)), size)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            for r in x:
                if (component == root(r[2])).all():
                    continue
                own = np.frombuffer(r[4], "<u8")
                lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                runs = hi - lo
                at = np.repeat(lo - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
                common = np.bincount(owner[at], minlength=len(y))
                linked = 100 * common >= percent * (size + len(own) - common)
                near = np.flatnonzero(linked & (component != root(r[2])))
                for j in near[np.unique(component[near], return_index=True)[1]]:
                    joined[int(component[j])] = root(r[2])
                    yield min(r[1], y[j][1]), max(r[1], y[j][1])
                if len(near):
                    component = tops()

        yield from _units(batches, found, PAIR)

    return run


def _between_components(members, labels, nodes, docs, width, percent):
    """Confirmed links of nodes that share a bucket and lie in different components.

    A unit is a block of nodes outside the bucket's largest component and a block of all
    its nodes. Tasks give back the members that may link, then the links found on their
    full sets that join components, fewer than components met; no pairs are written out.
    """
    labelled = cut(
        members.join(labels, "id", "left").select(
            "key", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component")
        )
    )
    counts = labelled.groupBy("key", "component").agg(
        F.count("*").alias("m"), F.sum("n_shingles").alias("s")
    )
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / SET_BLOCK)).cast("int")
    mixed = cut(
        counts.groupBy("key")
        .agg(
            F.count("*").alias("components"),
            F.sum("m").alias("n"),
            F.sum("s").alias("s"),
            F.max(F.struct("m", "component", "s")).alias("main"),
        )
        .filter("components > 1")
        .select(
            "key",
            F.col("main.component").alias("main"),
            blocks(F.col("n") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("xs"),
            blocks(F.col("n"), F.col("s")).alias("ys"),
        )
    )
    rows = labelled.join(mixed, "key")
    place = F.xxhash64("id", "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    row = ["id", "component", "n_shingles", "band"]
    x = rows.filter("component != main").select(
        "key", F.pmod(place, "xs").cast("int").alias("x"), every(F.col("ys")).alias("y"), F.lit(True).alias("is_x"), *row
    )
    y = rows.select(
        "key", every(F.col("xs")).alias("x"), F.pmod(place, "ys").cast("int").alias("y"), F.lit(False).alias("is_x"), *row
    )
    units = x.unionByName(y).select(
        F.xxhash64("key", "x", "y").alias("unit"), "id", "component", "is_x", "n_shingles", "band"
    )
    signed = units.join(nodes.select("id", "signature"), "id").select(
        "unit", "id", "component", "is_x", "signature", "n_shingles", "band"
    )
    some = cut(
        signed.repartition("unit").sortWithinPartitions("unit").mapInArrow(_may_link, MEMBER)
    )
    sets = _shingle_sets(cut(some.select("id").distinct()), nodes, docs, width)
    whole = some.join(sets, "id").select("unit", "id", "component", "is_x", "set")
    links = whole.repartition("unit").sortWithinPartitions("unit").mapInArrow(_exact(percent), PAIR)
    return cut(links.distinct())


def grouped(docs, width=5, percent=80):
    """doc_id, content key, n_shingles, group and component_id of every row.

    `group` numbers the components, `component_id` is the smallest doc_id in reach; both
    are null for rows without shingles. Size filter, signature check and bands are made
    for 80 percent: a smaller one is refused.
    """
    if percent < 80:
        raise ValueError("links below 80 percent would be lost: size filter, signatures and bands are made for 80")
    features = signatures(docs, width)
    # Equal sets have equal signatures, so any row's will do; the number is fixed once written.
    nodes = cut(
        features.filter("n_shingles > 0")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("row"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    rows = nodes.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = cut(
        rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    )
    members = cut(rows.join(shared, "key"))
    best = (
        members.filter("a != id")
        .groupBy("a", F.col("id").alias("b"))
        .agg(F.count("*").alias("bands"))
        .groupBy("b")
        .agg(F.max(F.struct(F.col("bands"), (-F.col("a")).alias("a"))).alias("best"))
        .select((-F.col("best.a")).alias("a"), "b")
    )
    first = cut(best)
    links = _confirm(cut(_check_signatures(first, nodes)), nodes, docs, width, percent)
    labels = star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    extra = _between_components(members, labels, nodes, docs, width, percent)
    edges = labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(
        extra.select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    labels = star_components(edges)
    placed = nodes.join(labels, "id", "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "id").alias("group"), "row.doc_id"
    )
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = cut(placed.drop("doc_id").join(least, "group"))
    return features.select("doc_id", "k1", "k2", "n_shingles", "fp1", "fp2").join(
        named, ["fp1", "fp2", "n_shingles"], "left"
    ).drop("fp1", "fp2")


def near_duplicates(docs, width=5, percent=80):
    """doc_id, n_shingles, component_id (smallest doc_id in reach) and kept per row."""
    found = grouped(docs, width, percent)
    component = F.coalesce("component_id", F.when(F.col("group").isNull(), F.col("doc_id")))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def without_duplicates(docs, width=5, percent=80):
    """The documents less all but one row of each component, all columns as they were.

    The row with the smallest doc_id stays (null ids last), of several such the one with
    the smallest content key, of equal rows one. Rows without shingles all stay.
    """
    found = cut(grouped(docs, width, percent).filter("group is not null").drop("n_shingles"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    several = found.groupBy("group").agg(F.count("*").alias("n"), F.min(row).alias("stays")).filter("n > 1")
    verdicts = cut(
        found.groupBy("group", "doc_id", "k1", "k2").agg(F.count("*").alias("copies"))
        .join(several, "group")
        .withColumn("goes", row != F.col("stays"))
        .filter("goes or copies > 1")
        .select("doc_id", "k1", "k2", "goes")
    )
    columns = [F.col(f"r.`{c}`") for c in docs.columns]
    rows = docs.select(F.struct("*").alias("r"), F.col("doc_id").cast("long").alias("doc_id"), *content_key(F.col("text")))
    rows = rows.select("r", F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "k1", "k2").alias("_key"))
    keys = verdicts.select(F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "k1", "k2").alias("_key"), "goes")
    few = keys.count() <= BROADCAST_IDS
    keys = F.broadcast(keys) if few else keys
    judged = rows.join(keys, "_key", "left")
    once = judged.filter("goes is null").select("r")
    repeated = judged.filter("not goes").groupBy("_key").agg(F.first("r").alias("r")).select("r")
    return once.unionByName(repeated).select(*columns)
