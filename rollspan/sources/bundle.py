"""Result bundles: sinks, scans and integrity."""

import contextlib
import ctypes
import ctypes.util
import functools
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from rollspan.functions.hashing import fingerprint_frame
from rollspan.operators.contracts import check_coverage, merge, validate_quantiles
from rollspan.operators.splits import refuse
from rollspan.session import cut
from rollspan.tables import CELL

TABLES = ("predictions", "metrics", "comparisons", "runtime")


FILE_ROWS = 2**22  # rows of a bundle's file, so that a task digests it as one row
OPEN_CELLS = 8  # cells whose files a task writes side by side; with more it sorts its rows


@contextlib.contextmanager
def _side_by_side(spark, writers=OPEN_CELLS):
    """Let a task write the files of a few cells at once, without sorting its rows by cell."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(writers, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _file_marks(spark, path, declared):
    """A digest of each table's files, bound to its declared rows and fingerprint."""
    depth = len(CELL) + 2
    called = lambda p: F.array_join(F.slice(F.split(p, "/"), -depth, depth), "/")
    files = file_digests(spark, path, "*.parquet", called).withColumn("table", F.substring_index("name", "/", 1))
    line = F.concat_ws("|", "name", "size", "sha256")
    lists = files.filter(F.col("table").isin(*TABLES)).groupBy("table").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("files")
    )
    marks = {}
    for name, digest in lists.collect():
        if name in declared:
            marks[name] = hashlib.sha256("|".join(map(str, (digest, *declared[name]))).encode()).hexdigest()
    return marks


def write_bundle(tables, path):
    """The four tables, partitioned by cell, and their fingerprints.

    The fingerprints are taken from the rows as stored: another pass over the files costs
    less than summing the digests up in the write job. The digests of the files go beside
    them. Every table is refused if it exists; the fingerprints come last, so a bundle
    without them is incomplete.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"a bundle holds {TABLES}")
    spark, marks = tables[TABLES[0]].sparkSession, {}
    for name in TABLES:
        writer = tables[name].write.partitionBy(*CELL).mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS)
        with _side_by_side(spark):
            writer.parquet(f"{path}/{name}")
        # In the given types: Spark guesses those of the cell columns from the folders' names.
        stored = spark.read.schema(tables[name].schema).parquet(f"{path}/{name}")
        marks[name] = tuple(fingerprint_frame(stored).first())
    files = _file_marks(spark, path, marks)
    rows = [(name, *marks[name], files.get(name)) for name in TABLES]
    declared = spark.createDataFrame(rows, "table string, rows long, fingerprint string, files string")
    declared.coalesce(1).write.mode("errorifexists").parquet(f"{path}/fingerprints")


def check_bundle(spark, path):
    """Per table whether its rows are those that were written (table, rows, intact).

    A table whose files are byte for byte those that were written is intact. Any other one
    is judged by its rows, so a copy that Spark laid out anew passes too.
    """
    declared = spark.read.parquet(f"{path}/fingerprints")
    held = {r["table"]: r.asDict() for r in declared.collect()}
    files = _file_marks(spark, path, {name: (r["rows"], r["fingerprint"]) for name, r in held.items()})
    same = [name for name in TABLES if name in files and files[name] == held[name].get("files")]
    found = [declared.filter(F.col("table").isin(*same)).select("table", "rows", "fingerprint")] if same else []
    for name in TABLES:
        if name not in same:
            rows = fingerprint_frame(spark.read.parquet(f"{path}/{name}"))
            found.append(rows.select(F.lit(name).alias("table"), "rows", "fingerprint"))
    kept = F.col("d.rows").eqNullSafe(F.col("f.rows")) & F.col("d.fingerprint").eqNullSafe(F.col("f.fingerprint"))
    joined = merge(*found).alias("f").join(declared.alias("d"), "table", "left")
    return joined.select("table", "f.rows", kept.alias("intact"))


def read_bundle(spark, path):
    """The tables of a bundle; one whose content is not its fingerprint's is refused."""
    broken = sorted(r["table"] for r in check_bundle(spark, path).filter("not intact").collect())
    if broken:
        raise ValueError(f"bundle table {broken[0]} differs from its fingerprint")
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def acf_rows(curves):
    """One row per trajectory, feature and lag; a constant keeps one empty row."""
    exploded = curves.select("trajectory_id", "feature_id", F.posexplode_outer("acf"))
    return exploded.select(
        "trajectory_id",
        "feature_id",
        F.coalesce("pos", F.lit(0)).alias("lag"),
        F.col("col").alias("acf"),
    )


def write_acf_csv(curves, path):
    """The curve table as CSV with a header."""
    acf_rows(curves).write.mode("errorifexists").option("header", True).csv(path)


SEGMENT = 2**28  # bytes of a file that one task reads
ROW_LIMIT = SEGMENT
CHUNK = 8 << 20


def _store(path):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    plain = path.removeprefix("file:")
    local = plain != path or "://" not in path
    return (fs.LocalFileSystem(), "/" + plain.lstrip("/")) if local else fs.FileSystem.from_uri(path)


def _written(batches, folder):
    """Write a file per row; a file appears whole, and a task that runs twice writes it again."""
    store, root = _store(folder)
    for batch in batches:
        for name, part, text in zip(*[batch.column(c).to_pylist() for c in ("name", "part", "text")]):
            store.create_dir(f"{root}/{part}", recursive=True)
            held = f"{root}/{part}/.{uuid.uuid4().hex}"
            with store.open_output_stream(held, compression=None) as stream:
                stream.write(text.encode())
            store.move(held, f"{root}/{part}/{name}")
        yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})


def write_files(lines, folder, parts=256):
    """A text file per `name` with the `value` lines of that name; returns how many.

    The tasks write the files themselves: a folder per name and a commit that moves each on
    the driver would cost far more than the files. They lie in `parts` folders, as
    `f-<url-encoded name>.txt`.
    """
    text = F.concat(F.array_join(F.array_sort(F.collect_list("value")), "\n"), F.lit("\n"))
    files = lines.groupBy("name").agg(text.alias("text")).select(
        F.concat(F.lit("f-"), F.url_encode("name"), F.lit(".txt")).alias("name"),
        F.pmod(F.xxhash64("name"), F.lit(parts).cast("long")).alias("part"), "text",
    )
    done = files.mapInArrow(functools.partial(_written, folder=folder), "files long")
    return done.agg(F.sum("files")).first()[0] or 0


def file_name(path):
    """The name that `write_files` made a file's path from."""
    return F.url_decode(F.regexp_extract(path, r"/f-([^/]*)\.txt$", 1))


def _streamed(batches):
    """Digests of files read chunk by chunk; only the hash states are carried."""
    for batch in batches:
        marks = []
        for path in batch.column("path").to_pylist():
            store, at = _store(path)
            sha, md5 = hashlib.sha256(), hashlib.md5()
            with store.open_input_stream(at, compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    sha.update(chunk)
                    md5.update(chunk)
            marks.append((sha.hexdigest(), md5.hexdigest()))
        columns = [pa.array([m[i] for m in marks], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("name"), batch.column("size"), *columns], names=["name", "size", "sha256", "md5"]
        )


# Digest and bytes of its context, the plain structs SHA256_CTX and MD5_CTX of OpenSSL's headers.
CONTEXTS = {"sha256": ("SHA256", 32, 112), "md5": ("MD5", 16, 92)}


def _crypto():
    """OpenSSL's library, whose hash contexts can be carried on, or None where it has none."""
    named = ctypes.util.find_library("crypto")
    library = ctypes.CDLL(named) if named else None
    steps = [f"{name}_{step}" for name, *_ in CONTEXTS.values() for step in ("Init", "Update", "Final")]
    return library if library is not None and all(hasattr(library, s) for s in steps) else None


class _Hash:
    """A hash whose context is bytes, so that another task can go on with it."""

    def __init__(self, library, kind, held=None):
        self.library = library
        self.name, self.digest_size, size = CONTEXTS[kind]
        self.context = ctypes.create_string_buffer(held or bytes(size), size)
        if held is None:
            self._call("Init", self.context)

    def _call(self, step, *args):
        if getattr(self.library, f"{self.name}_{step}")(*args) != 1:
            raise RuntimeError(f"{self.name} failed")

    def update(self, data):
        self._call("Update", self.context, data, ctypes.c_size_t(len(data)))

    def digest(self):
        out = ctypes.create_string_buffer(self.digest_size)
        self._call("Final", out, self.context)
        return out.raw

    def held(self):
        return self.context.raw


def _advanced(batches, segment):
    """Files' hashes `segment` bytes further on: contexts, or the digests at a file's end.

    Where contexts cannot be carried on, a file is read whole.
    """
    library = _crypto()
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            left = row["size"] - row["at"]
            if left == 0:
                continue
            if library is not None:
                left = min(left, segment)
                hashes = {kind: _Hash(library, kind, row[kind]) for kind in CONTEXTS}
            else:
                hashes = {kind: hashlib.new(kind) for kind in CONTEXTS}
            store, at = _store(row["path"])
            with store.open_input_file(at) as file:
                file.seek(row["at"])
                row["at"] += left
                while left:
                    chunk = file.read(min(CHUNK, left))
                    if not chunk:
                        raise EOFError(f"{row['path']} is shorter than it was when listed")
                    left -= len(chunk)
                    for state in hashes.values():
                        state.update(chunk)
            ended = row["at"] == row["size"]
            row.update({kind: state.digest() if ended else state.held() for kind, state in hashes.items()})
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _chained(large, segment):
    """Digests of files above `segment` bytes: in every round a task a file reads the next segment.

    A hash takes a file's bytes in order, so tasks hand its context on, by the shared folder.
    The rounds follow the longest file.
    """
    first = large.withColumns({"at": F.lit(0).cast("long"), **{k: F.lit(None).cast("binary") for k in CONTEXTS}})
    state = cut(first)
    files, longest = state.agg(F.count(F.lit(1)), F.max("size")).first()
    if files == 0:
        return None
    columns = "path string, name string, size long, at long, sha256 binary, md5 binary"
    step = functools.partial(_advanced, segment=segment)
    for _ in range(-(-longest // segment)):
        # By range and a fixed number: a task a file; adaptive execution would put the few short rows into one.
        dealt = state.select("path", "name", "size", "at", *CONTEXTS).repartitionByRange(files, "path")
        state = cut(dealt.mapInArrow(step, columns))
    return state.select("name", "size", *[F.lower(F.hex(k)).alias(k) for k in CONTEXTS])


def file_digests(spark, path, glob="*", name=None, row_limit=ROW_LIMIT, segment=SEGMENT):
    """Name, size and digests of every file, hashed by the tasks that read them.

    A file of at most `row_limit` bytes is one row. A larger one is never a row: a task of
    its own streams it in chunks. Of one above `segment` bytes, a task reads a segment and
    hands the hashes on. Spark lists no empty file. `name` makes a file's name from its
    path; the last part is the default.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = files.option("recursiveFileLookup", True).load(path)
    called = (name or (lambda p: F.element_at(F.split(p, "/"), -1)))(F.col("path")).alias("name")
    size, length = F.col("length").alias("size"), F.col("length")
    small = files.filter(length <= min(row_limit, segment)).select(
        called, size, F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")
    )
    parts = [small]
    if row_limit < segment:
        middle = files.filter((length > row_limit) & (length <= segment)).select("path", called, size)
        parts.append(
            middle.repartition("path").mapInArrow(_streamed, "name string, size long, sha256 string, md5 string")
        )
    # By the listing, which opens no file.
    large = _chained(files.filter(F.col("_metadata.file_size") > segment).select("path", called, size), segment)
    return merge(*parts) if large is None else merge(*parts, large)


def verify_files(digests, manifest):
    """Manifest entries (name, size, algorithm, digest) that do not hold."""
    rows = manifest.alias("m").join(digests.alias("d"), "name", "full_outer")
    actual = F.when(F.col("m.algorithm") == "md5", F.col("d.md5")).otherwise(F.col("d.sha256"))
    reason = (
        F.when(F.col("d.size").isNull(), "missing")
        .when(F.col("m.digest").isNull(), "unlisted")
        .when(F.col("m.size") != F.col("d.size"), "size differs")
        .when(F.col("m.digest") != actual, "digest differs")
    )
    return rows.select("name", reason.alias("reason")).filter(F.col("reason").isNotNull())


def register_forecasts(forecasts, model, index):
    """Outside forecasts (levels and quantiles per row) on the declared windows.

    The point is the 0.5 quantile; coverage and the quantile contract must hold.
    """
    at = F.array_position("levels", 0.5)
    rows = forecasts.withColumn("model", F.lit(model)).withColumn(
        "point", F.when(at > 0, F.get("quantiles", (at - 1).cast("int")))
    )
    refuse(rows.filter(F.col("point").isNull()), "a forecast row lacks the 0.5 level")
    refuse(check_coverage(rows, index), "forecasts do not cover the declared windows")
    refuse(validate_quantiles(rows), "quantile contract is broken")
    return rows


def read_metrics(spark, path, level="aggregate"):
    """Metric rows of one level; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("level") == level)
