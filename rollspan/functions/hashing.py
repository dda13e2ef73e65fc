"""Hash ranks, identity keys and table fingerprints."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rollspan.functions.blocks import ordered_index


def hash_rank(df, digest, ties, name, keys=()):
    """Zero-based rank by hexadecimal digest.

    Digests are uniform, so their first three digits cut the rows into 4,096 even
    buckets: no task ever orders the whole table.
    """
    rows = df.withColumn("_digest", digest)
    return ordered_index(
        rows, keys, F.substring("_digest", 1, 3), ["_digest", *ties], name
    ).drop("_digest")


def encode(column):
    """Percent-encode one identity part (a blank is %20, not +)."""
    return F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))


def identity(*parts):
    """Namespaced key from encoded parts; null when a part is blank or padded."""
    ok = F.lit(True)
    for part in parts:
        text = part.cast("string")
        ok = ok & F.coalesce((text != "") & (F.trim(text) == text), F.lit(False))
    return F.when(ok, F.concat_ws(":", *[encode(p.cast("string")) for p in parts]))


def row_digest(df, keys=None):
    """SHA-256 of each row's JSON, columns in name order."""
    columns = sorted(keys or df.columns)
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _with_words(df, digest):
    """Add a digest's four 64-bit words, as signed numbers, each converted once per row."""
    rows = df.withColumn("_digest", digest)
    words = [F.conv(F.substring("_digest", 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]
    return rows.withColumns({f"_w{i}": w for i, w in enumerate(words)}).drop("_digest")


def _quarter_sums():
    """Sums of the words' 16-bit quarters: plain longs that hold 2^47 rows."""
    quarters = [
        F.shiftrightunsigned(f"_w{i}", 48 - 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long"))
        for i in range(4) for j in range(4)
    ]
    return [F.coalesce(F.sum(q), F.lit(0).cast("long")).alias(f"q{n}") for n, q in enumerate(quarters)]


def observed_fingerprint(df, keys=None):
    """(df with an observation, function giving rows and fingerprint once df was written).

    The sums are taken while the rows pass by, so the table is not read again. The digest
    is a column below the observation, whose sums would each evaluate it anew.
    """
    seen = Observation()
    rows = _with_words(df, row_digest(df, keys))
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *_quarter_sums()).select(*[f"`{c}`" for c in df.columns])

    def result():
        found = seen.get
        limbs = [(found[f"q{2 * i}"] << 16) + found[f"q{2 * i + 1}"] for i in range(8)]
        text = "|".join(str(v) for v in (found["rows"], *limbs))
        return found["rows"], hashlib.sha256(text.encode()).hexdigest()

    return watched, result


def _limb_sums(batches):
    """Per batch its rows and the sums of their digests' eight 32-bit limbs."""
    for batch in batches:
        if batch.num_rows:
            held = batch.column(0).cast(pa.binary(32))
            limbs = np.frombuffer(held.buffers()[1], ">u4").reshape(-1, 8)[held.offset : held.offset + len(held)]
            sums = [pa.array([int(total)], pa.int64()) for total in limbs.sum(axis=0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(held)], pa.int64()), *sums], names=["rows", *[f"l{i}" for i in range(8)]]
            )


def fingerprint_frame(df, keys=None):
    """One row: content identity that ignores row order and counts duplicates.

    The row digests are added up limb by limb (eight of 32 bits), a batch at a time: in
    Spark's expressions, turning digits to numbers costs as much as the digest. The state
    is a few numbers however many rows there are, and partial sums merge.
    """
    digests = df.select(F.unhex(row_digest(df, keys)).alias("digest"))
    limbs = [f"l{i}" for i in range(8)]
    parts = digests.mapInArrow(_limb_sums, ", ".join(f"{c} long" for c in ("rows", *limbs)))
    sums = parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"),
        *[F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(c) for c in limbs],
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), *limbs)
    return sums.select("rows", F.sha2(text, 256).alias("fingerprint"))


def fingerprint(df, keys=None):
    """The fingerprint as a string (one small job)."""
    return fingerprint_frame(df, keys).first()["fingerprint"]
