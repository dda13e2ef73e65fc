"""Hard negatives by tiled integer products, multiplied by Strassen's recursion.

1. Anchors are packed into files of at most ANCHORS rows in the shared folder, each a
   zero-padded int64 tile with ids and labels. The driver holds one row per file.
2. A task holds a chunk of at most CHUNK candidates and goes through the anchor files one
   at a time. A tile of anchors times a tile of candidates is a matrix product by
   Strassen's seven products on zero-padded halves; additions wrap modulo 2^64, so the
   scores are exact, as they themselves fit (else the job stops).
3. First pass: the `positives` best rows of the anchor's label, a heap per anchor and
   chunk; heaps merge by rank. Second pass: with the positives' scores each anchor has
   windows, and a chunk keeps the `negatives` best different-label rows inside each;
   these window heaps merge by rank too. Ranks keep few rows per anchor before they are
   shuffled, so no group grows with more than the number of chunks.

Components become floor(scale x) with x as double. Rows with a null or empty vector, a
null or non-finite component, a null label or a null id take no part; shorter vectors
count as padded with zeros. Higher scores come first, ties by smaller id. A row never
meets its own id. Every row whose id is divisible by `every` is an anchor; repeated
anchor rows are anchors of their own and give their rows each. Scores must stay below
2^63 / 100 in size. Extra columns are ignored; an empty table gives no rows.
"""

import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.llm.files import new_folder, open_input, open_output

ANCHORS = 512
CHUNK = 16_384
TILE = 4_096
LEAF = 12  # sides below twice this are multiplied directly
LIMIT = float(2**63 // 100)

POSITIVES = "anchor string, anchor_id long, vec_id long, score long"
NEGATIVES = (
    "anchor string, anchor_id long, nth int, positive_id long, positive_score long, "
    "vec_id long, score long"
)


def prepared(embeddings, scale, label, vector="embedding", key="vec_id"):
    """vec_id, label and integer components of every row that takes part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(
        F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")
    )
    return rows.filter("vec_id is not null and label is not null").filter((F.size("x") > 0) & fine).select(
        "vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("v")
    )


def strassen(a, b):
    """The product of two int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) < 2 * LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = (side // 2 for side in (a.shape[0], a.shape[1], b.shape[1]))
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p = strassen(a11 + a22, b11 + b22)
    q = strassen(a21 + a22, b11)
    r = strassen(a11, b12 - b22)
    s = strassen(a22, b21 - b11)
    t = strassen(a11 + a12, b22)
    u = strassen(a21 - a11, b11 + b12)
    w = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p + s - t + w
    out[:i, l:] = r + t
    out[i:, :l] = q + s
    out[i:, l:] = p - q + r + u
    return out[:m, :n]


def _matrix(vectors):
    """Zero-padded int64 rows of an Arrow list column."""
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    values = np.asarray(vectors.flatten())
    width = int(lengths.max())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _pack(folder):
    """Write a partition's anchors into files; give back the files' names."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(lo, ANCHORS)
                name = uuid.uuid4().hex
                x = _matrix(part.column("v"))
                with open_output(folder, name) as stream:
                    np.save(stream, np.array(x.shape))
                    for values in (part.column("vec_id"), part.column("label"), x):
                        np.save(stream, np.asarray(values).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def _load(folder, name):
    import io

    with open_input(folder, name) as stream:
        held = io.BytesIO(stream.read())
    np.load(held)
    return tuple(np.load(held) for _ in range(3))


class Chunk:
    """At most CHUNK candidates in order of their ids, and their products with anchors."""

    def __init__(self, batches):
        self.ids = np.concatenate([np.asarray(b.column("vec_id")) for b in batches])
        self.labels = np.concatenate([np.asarray(b.column("label")) for b in batches])
        parts = [_matrix(b.column("v")) for b in batches]
        width = max(p.shape[1] for p in parts)
        x = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, self.x = self.ids[order], self.labels[order], x[order]
        self.largest = float(np.abs(x.astype(float)).max())

    def scores(self, anchors):
        """Scores of anchors (rows) with all candidates of the chunk, tile by tile."""
        width = max(anchors.shape[1], self.x.shape[1])
        if self.largest * float(np.abs(anchors.astype(float)).max()) * width >= LIMIT:
            raise ValueError("scores of 2^63 / 100 or more are not supported")
        a = np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
        out = np.empty((len(a), len(self.x)), np.int64)
        for lo in range(0, len(self.x), TILE):
            x = self.x[lo : lo + TILE]
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            out[:, lo : lo + TILE] = strassen(a, x.T)  # both sides run along their inner side in memory
        return out


def _chunks(batches):
    held, rows = [], 0
    for batch in batches:
        while rows + batch.num_rows > CHUNK:
            held.append(batch.slice(0, CHUNK - rows))
            yield Chunk([b for b in held if b.num_rows])
            batch, held, rows = batch.slice(CHUNK - rows), [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield Chunk(held)


def _best(score, at, k):
    """The places of the k best of some places in id order: by score, ties by smaller id."""
    if len(at) > k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _positives(folder, names, k):
    def run(batches):
        for chunk in _chunks(batches):
            for name in names:
                ids, labels, x = _load(folder, name)
                found = []
                for i, row in enumerate(chunk.scores(x)):
                    own = np.flatnonzero((chunk.labels == labels[i]) & (chunk.ids != ids[i]))
                    best = _best(row, own, k)
                    found.append((np.full(len(best), i), chunk.ids[best], row[best]))
                i, vec, score = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array([f"{name}-{j:04d}" for j in i.tolist()], pa.string()),
                        "anchor_id": ids[i],
                        "vec_id": vec,
                        "score": score,
                    }
                )

    return run


def _store_windows(folder):
    """Write the positives of each anchor file, which arrive together and in order."""

    def write(held):
        name = f"{held[0][0][:32]}-{uuid.uuid4().hex}"
        with open_output(folder, name) as stream:
            np.save(stream, np.array([[int(r[0][33:]), *r[1:]] for r in held], np.int64))
        return name

    def run(batches):
        held = []
        for batch in batches:
            names = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0][:32] != row[0][:32]:
                    names.append(write(held))
                    held = []
                held.append(row)
            if names:
                yield pa.RecordBatch.from_pydict({"name": names})
        if held:
            yield pa.RecordBatch.from_pydict({"name": [write(held)]})

    return run


def _windows(folder, names, k, low, high):
    """The k best rows of another label whose score lies in each positive's window."""

    def run(batches):
        import io

        for chunk in _chunks(batches):
            for name in names:
                _, labels, x = _load(folder, name[:32])
                with open_input(folder, name) as stream:
                    asked = np.load(io.BytesIO(stream.read()))
                scores = chunk.scores(x)
                found = []
                last, row, other = -1, None, None
                for i, anchor_id, positive_id, score, nth in asked.tolist():
                    if i != last:
                        last, row = i, scores[i]
                        other = np.flatnonzero(chunk.labels != labels[i])
                        some = row[other]
                    least, most = -(-low * score // 100), high * score // 100
                    at = other[(some >= least) & (some <= most)]
                    best = _best(row, at, k)
                    found.extend(
                        (f"{name[:32]}-{i:04d}", anchor_id, nth, positive_id, score, v, s)
                        for v, s in zip(chunk.ids[best].tolist(), row[best].tolist())
                    )
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(column, kind)
                            for column, kind in zip(
                                zip(*found),
                                (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4),
                            )
                        ],
                        names=[f.split()[0] for f in NEGATIVES.split(", ")],
                    )

    return run


def _ranked(rows, by, k):
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings, label, every=50, scale=256, positives=5, negatives=3, low=50, high=95):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `label` is a column of the label that counts. A negative's score lies between `low`
    and `high` percent of the positive's.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings, scale, label)
    folder = new_folder(spark)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    count = anchors.count()
    spread = anchors.repartition(max(1, -(-count // ANCHORS)), F.xxhash64("vec_id", "label", "v"))
    names = sorted(r["name"] for r in spread.mapInArrow(_pack(folder), "name string").collect())
    best = _ranked(rows.mapInArrow(_positives(folder, names, positives), POSITIVES), ["anchor", "anchor_id"], positives)
    asked = best.select("anchor", "anchor_id", "vec_id", "score", "rank", F.substring("anchor", 1, 32).alias("file"))
    stored = (
        asked.repartition("file")
        .sortWithinPartitions("anchor", "rank")
        .drop("file")
        .mapInArrow(_store_windows(folder), "name string")
    )
    files = sorted(r["name"] for r in stored.collect())
    found = rows.mapInArrow(_windows(folder, files, negatives, low, high), NEGATIVES)
    by = ["anchor", "anchor_id", "nth", "positive_id", "positive_score"]
    return _ranked(found, by, negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
