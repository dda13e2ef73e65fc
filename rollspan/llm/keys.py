"""Content keys: a text known by two 64-bit hashes."""

from pyspark.sql import functions as F


def content_key(text):
    """Columns k1 and k2 of a text column; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(41), F.length(t), t).alias("k2")
