"""Concatenate and cut: fixed windows over one global token stream.

Pass 1 encodes documents where they are read and stores their ids with a running
offset inside the partition. The partitions' totals (one row each) get prefix sums,
which turn the running offsets into global ones. Pass 2 cuts every document at the
multiples of `length` and gives one boundary record per piece; a document that
crosses several windows gives several. Nothing is shuffled, and only the last sequence
of all is short.

Null and empty texts give the end id alone. Repeated rows and null doc_ids are
documents like any other. Other columns are ignored; an empty table packs to nothing.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm import worker
from rollspan.llm.tokens import SLICE, encoder, slices, with_ends
from rollspan.session import scratch

IDS_SCHEMA = "doc_id long, part int, start long, n_tokens long, width int, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _encode(tokenizer, end_id):
    def encode(batches):
        from pyspark import TaskContext

        enc, at = encoder(tokenizer), 0
        width = enc.dtype.itemsize
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi in slices(batch, SLICE):
                rows = batch.slice(lo, hi - lo)
                ids, sizes = with_ends(*enc.encode(rows.column("text")), end_id)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                n = len(sizes)
                bounds = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int32)
                codes = pa.BinaryArray.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(np.full(n, width, np.int32)),
                        codes,
                    ],
                    names=["doc_id", "part", "start", "n_tokens", "width", "ids"],
                )
        worker.release()

    return encode


def encode_documents(docs, tokenizer, end_id=1):
    """Written table of ids per document with running offsets inside each partition."""
    spark = docs.sparkSession
    path = scratch(spark)
    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encode(tokenizer, end_id), IDS_SCHEMA
    )
    encoded.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(encoded.schema).parquet(path)


def partition_bases(encoded):
    """part -> ids of all partitions before it (one entry a partition)."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    bases, base = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        bases[row["part"]] = base
        base += row["n"]
    return bases


def _cut(bases, length):
    def cut(batches):
        import zlib

        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = np.asarray(batch.column("n_tokens"))
            parts = batch.column("part").to_pylist()
            begin = np.asarray(batch.column("start")) + np.array([bases[p] for p in parts])
            first, last = begin // length, (begin + sizes - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(sizes)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            window = first[row] + nth
            lo = np.maximum(window * length, begin[row])
            hi = np.minimum((window + 1) * length, begin[row] + sizes[row])
            local = lo - begin[row]
            widths = batch.column("width").to_pylist()
            ids = batch.column("ids")
            sums = np.empty(len(row), np.int64)
            held, values = -1, None
            for k, i in enumerate(row):
                if i != held:
                    values = np.frombuffer(ids[int(i)].as_buffer(), f"<u{widths[i]}")
                    held = i
                piece = values[local[k] : local[k] + hi[k] - lo[k]]
                sums[k] = zlib.crc32(piece.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(local),
                    pa.array(hi - lo),
                    pa.array(sums),
                    pa.array(sizes[row]),
                    pa.array(window),
                    pa.array(lo - window * length),
                ],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

    return cut


def pack(docs, tokenizer, end_id=1, length=2048):
    """One boundary record per piece: document range, sequence and offset there."""
    encoded = encode_documents(docs, tokenizer, end_id)
    return encoded.mapInArrow(_cut(partition_bases(encoded), length), PIECES)


def sequences(encoded, pieces, length=2048):
    """The packed sequences: sequence_id, width, and the pieces' id bytes in order.

    Pieces meet the stored ids on their document's global offset. A sequence has at
    most `length` ids, so its pieces fit one row.
    """
    bases = partition_bases(encoded)
    base = F.create_map(*[x for k, v in bases.items() for x in (F.lit(k), F.lit(v))])
    stored = encoded.select(
        (F.col("start") + base[F.col("part")]).alias("_global"), "width", "ids"
    )
    first = F.col("sequence_id") * length + F.col("offset") - F.col("start")
    code = F.expr("substring(ids, int(start * width + 1), int(length * width))")
    return (
        pieces.withColumn("_global", first)
        .join(stored, "_global")
        .groupBy("sequence_id")
        .agg(
            F.max("width").alias("width"),
            F.array_sort(F.collect_list(F.struct("offset", code.alias("ids")))).alias("pieces"),
        )
    )
