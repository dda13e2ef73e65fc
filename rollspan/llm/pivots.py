"""Exact top-k inner products with pivot-table elimination.

Every vector's distances to a fixed number of pivots are computed once and stored with
it. For a query q and a row x the triangle inequality gives d(q, x) >= max over pivots of
|d(q, p) - d(x, p)|, and with both norms an upper bound of the inner product. A task
takes the stored rows batch by batch, visits each query's rows in the order of that
bound and stops when the bound falls below the query's k-th best score. Pivots are rows
of the table, so their exact scores give every query a first threshold. Tasks keep k
rows per query and batch run; the last cut is a rank over those.

Queries are packed into files of at most QUERY_BLOCK rows in the shared folder; the
driver holds one name per file. A task takes a chunk of at most CHUNK rows through the
files one at a time, so neither side grows in a task and the table is scanned once.

Components become floor(1024 x) with x as double. Vectors that are null or empty or
hold null or non-finite components take no part. Shorter vectors count as padded with
zeros. Equal scores rank the smaller vec_id first; repeated vec_ids are rows of their
own, as candidates and as queries (each query row gets its k rows), except that a query
never meets a row of its own vec_id. Rows with a null vec_id
take no part. Scores must stay below 2^53. Extra columns are ignored.
"""

import io
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.llm.files import new_folder, open_input, open_output
from rollspan.session import cut

PIVOTS = 24
QUERY_BLOCK = 1024
CHUNK = 16_384
STEP = 512
EXACT = 2.0**53


def scaled(embeddings, vector="embedding", key="vec_id"):
    """vec_id and integer components of every vector that takes part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    return (
        embeddings.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & fine)
        .select("vec_id", F.transform("x", lambda v: F.floor(v * 1024)).alias("v"))
    )


def choose_pivots(rows, count=PIVOTS):
    """A fixed number of rows, spread by hash: (ids, matrix)."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(count).collect()
    width = max((len(r["v"]) for r in some), default=0)
    return np.array([r["vec_id"] for r in some]), _matrix([r["v"] for r in some], width)


def _matrix(vectors, width):
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _distances(x, pivots):
    """Distances of rows to pivots; shorter sides count as padded with zeros."""
    wide = max(x.shape[1], pivots.shape[1])
    a = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    b = np.pad(pivots, ((0, 0), (0, wide - pivots.shape[1])))
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def pivot_table(rows, pivots):
    """Written table: vec_id, v and the distances to all pivots."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column("v").to_pylist()
            x = _matrix(v, max(map(len, v)))
            d = _distances(x, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(list(d), pa.list_(pa.float64()))],
                names=["vec_id", "v", "d"],
            )

    return cut(rows.mapInArrow(run, "vec_id long, v array<long>, d array<double>"))


class _Best:
    """The k best (score, smaller id first) rows of every query of a block."""

    def __init__(self, queries, k, floor):
        self.k, self.floor = k, floor
        self.score = [np.zeros(0)] * queries
        self.vec = [np.zeros(0, np.int64)] * queries

    def threshold(self, q):
        own = self.score[q][self.k - 1] if len(self.score[q]) >= self.k else -np.inf
        return max(own, self.floor[q])

    def add(self, q, score, vec):
        keep = score >= self.threshold(q)
        if keep.any():
            s = np.concatenate([self.score[q], score[keep]])
            v = np.concatenate([self.vec[q], vec[keep]])
            order = np.lexsort((v, -s))[: self.k]
            self.score[q], self.vec[q] = s[order], v[order]


def _store(folder, pivots, pivot_ids, k):
    """Write a partition's queries into files (ids, vectors, pivot distances, thresholds)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(lo, QUERY_BLOCK)
                ids, v = np.asarray(part.column("vec_id")), part.column("v").to_pylist()
                q = _matrix(v, max(map(len, v)))
                at_pivots = q[:, : pivots.shape[1]] @ pivots[:, : q.shape[1]].T
                at_pivots = np.where(ids[:, None] == pivot_ids[None, :], -np.inf, at_pivots)
                floor = np.full(len(ids), -np.inf)
                if len(pivot_ids) > k:
                    floor = -np.sort(-at_pivots, axis=1)[:, k - 1]
                d = np.asarray(part.column("d").flatten()).reshape(len(ids), -1)
                name = uuid.uuid4().hex
                with open_output(folder, name) as stream:
                    for values in (ids, q, d, floor):
                        np.save(stream, values)
                yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def _load(folder, name):
    with open_input(folder, name) as stream:
        held = io.BytesIO(stream.read())
    return tuple(np.load(held) for _ in range(4))


def _chunks(batches):
    """(ids, vectors, pivot distances) of at most CHUNK rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            v = part.column("v").to_pylist()
            ids = np.asarray(part.column("vec_id"))
            yield ids, _matrix(v, max(map(len, v))), np.asarray(part.column("d").flatten()).reshape(len(ids), -1)


def _scan(folder, names, k):
    """The k best rows of a chunk for every query row, visited in bound order."""

    def run(batches):
        for vec, x, dx in _chunks(batches):
            own = (x * x).sum(axis=1)
            for name in names:
                ids, q, d, floor = _load(folder, name)
                norms, best = (q * q).sum(axis=1), _Best(len(ids), k, floor)
                if np.sqrt(own.max()) * np.sqrt(norms.max()) >= EXACT:
                    raise ValueError("scores of 2^53 or more are not supported")
                wide = min(x.shape[1], q.shape[1])
                for i in range(len(ids)):
                    lower = np.abs(dx - d[i]).max(axis=1) - 1e-6 * (1 + d[i].max())
                    bound = (norms[i] + own - np.maximum(lower, 0) ** 2) / 2 + 1e-3
                    bound[vec == ids[i]] = -np.inf
                    order = np.argsort(-bound)
                    for lo in range(0, len(order), STEP):
                        some = order[lo : lo + STEP]
                        if bound[some[0]] < best.threshold(i) or bound[some[0]] == -np.inf:
                            break
                        some = some[bound[some] > -np.inf]
                        best.add(i, x[some, :wide] @ q[i, :wide], vec[some])
                n = [len(s) for s in best.score]
                if sum(n):
                    row = np.repeat(np.arange(len(ids)), n)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query": pa.array([f"{name}-{j}" for j in row.tolist()], pa.string()),
                            "query_id": ids[row],
                            "vec_id": np.concatenate(best.vec),
                            "score": np.concatenate(best.score).astype(np.int64),
                        }
                    )

    return run


def top_k(embeddings, k=10, every=100, pivots=PIVOTS):
    """The k best rows of every query (vec_id divisible by `every`): query_id, rank, vec_id, score."""
    rows = scaled(embeddings)
    pivot_ids, matrix = choose_pivots(rows, max(pivots, k + 1))
    schema = "query string, query_id long, vec_id long, score long"
    if not len(pivot_ids):
        found = embeddings.sparkSession.createDataFrame([], schema)
    else:
        table, folder = pivot_table(rows, matrix), new_folder(embeddings.sparkSession)
        asked = table.filter(F.col("vec_id") % every == 0)
        parts = max(1, -(-asked.count() // QUERY_BLOCK))
        packed = asked.repartition(parts, F.xxhash64("vec_id", "v")).mapInArrow(
            _store(folder, matrix, pivot_ids, k), "name string"
        )
        names = sorted(r["name"] for r in packed.collect())
        found = table.mapInArrow(_scan(folder, names, k), schema)
    rank = F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    )
    return (
        found.withColumn("rank", rank.cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
