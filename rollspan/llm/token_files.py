"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped.

`write_tokens` range-partitions documents by doc_id, so that file order is doc_id
order. A task streams its documents to three files of its own:

    tokens-*.bin   ids of all documents in a row, unsigned 16- or 32-bit little-endian
    tokens-*.idx   n + 1 signed 64-bit offsets of the documents, in ids, from the file's start
    tokens-*.doc   n signed 64-bit doc_ids (the smallest value stands for null)

and returns their names and totals. Only these totals, one row a file, reach the
driver, where prefix sums give each file its base. The bases live in `manifest.json`.

Null and empty texts give the end id alone. Equal doc_ids keep every row and are
ordered by text; null doc_ids come first. Other columns are ignored, an empty table
gives no files. Texts are encoded whole; strings that look like special tokens are text.
"""

import json

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm.files import attempt_name, mapped, new_folder, open_input, open_output
from rollspan.llm.tokens import SLICE, crc32_of_ids, encoder, slices, with_ends

NO_ID = np.iinfo(np.int64).min
READ_IDS = 4_000_000
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(folder, tokenizer, end_id):
    def write(batches):
        enc = encoder(tokenizer)
        offsets, ids, streams, name = [np.zeros(1, np.int64)], [], None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if streams is None:
                name = attempt_name("tokens")
                streams = open_output(folder, name + ".bin")
            for lo, hi in slices(batch, SLICE):
                part = batch.slice(lo, hi - lo)
                ids.extend(NO_ID if x is None else x for x in part.column("doc_id").to_pylist())
                tokens, sizes = with_ends(*enc.encode(part.column("text")), end_id)
                streams.write(tokens.tobytes())
                offsets.append(offsets[-1][-1] + np.cumsum(sizes))
        if streams is None:
            return
        streams.close()
        offsets = np.concatenate(offsets)
        for ending, values in ((".idx", offsets), (".doc", ids)):
            with open_output(folder, name + ending) as out:
                out.write(np.array(values, "<i8").tobytes())
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "name": [name],
                "width": pa.array([enc.dtype.itemsize], pa.int32()),
                "docs": pa.array([len(ids)], pa.int64()),
                "tokens": pa.array([int(offsets[-1])], pa.int64()),
            }
        )

    return write


def write_tokens(docs, tokenizer, end_id=2):
    """Write the files; returns the folder's URI."""
    folder = new_folder(docs.sparkSession)
    parts = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(
            _writer(folder, tokenizer, end_id),
            "part int, name string, width int, docs long, tokens long",
        )
        .collect()
    )
    bases, base = [], 0
    for part in sorted(parts, key=lambda p: p["part"]):
        bases.append({**part.asDict(), "base": base})
        base += part["tokens"]
    with open_output(folder, "manifest.json") as out:
        out.write(json.dumps(bases).encode())
    return folder


def read_manifest(folder):
    """The files in order, each with its base, the ids of all files before it."""
    with open_input(folder, "manifest.json") as stream:
        return json.loads(stream.read())


def document_ids(folder, entry, i):
    """The ids of the i-th document of a file, without reading the others."""
    at = mapped(folder, entry["name"] + ".idx", "<i8", entry["docs"] + 1)
    lo, hi = int(at[i]), int(at[i + 1])
    width = entry["width"]
    return mapped(folder, entry["name"] + ".bin", f"<u{width}", hi - lo, lo * width)


def _reader(folder, files):
    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                f = files[k]
                at = mapped(folder, f["name"] + ".idx", "<i8", f["docs"] + 1)
                ids = mapped(folder, f["name"] + ".doc", "<i8", f["docs"])
                tokens = mapped(folder, f["name"] + ".bin", f"<u{f['width']}", f["tokens"])
                for lo in range(0, f["docs"], 10_000):
                    hi = min(lo + 10_000, f["docs"])
                    start = np.asarray(at[lo:hi])
                    sums = [crc32_of_ids(tokens[a:b]) for a, b in zip(start, at[lo + 1 : hi + 1])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[lo:hi], mask=np.asarray(ids[lo:hi]) == NO_ID),
                            pa.array(start + f["base"]),
                            pa.array(np.diff(at[lo : hi + 1])),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_tokens(spark, folder):
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = read_manifest(folder)
    if not files:
        return spark.createDataFrame([], READ_SCHEMA)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(_reader(folder, files), READ_SCHEMA)
