import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent.parent), str(HERE)]

# Columns whose names the operators use inside; they must not get in the way.
CLASHING = (
    "key string, id string, part int, start string, n int, shard string, virtual_slot string, "
    "component string, bands string, label int, x string, size string, kind string, item string"
)


@pytest.fixture
def table(spark):
    """A table of (doc_id, text) rows with clashing extra columns."""

    def build(rows, names="doc_id long, text string"):
        extra = tuple(None if t.endswith("int") else "?" for t in CLASHING.split(", "))
        return spark.createDataFrame([(*r, *extra) for r in rows], f"{names}, {CLASHING}")

    return build


@pytest.fixture
def odd_rows():
    """Null and empty texts, a null doc_id, repeated rows and a very long text."""
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    return [(1, None), (2, ""), (None, "no id here"), (3, "twice the same"), (3, "twice the same"), (4, long), (5, " \t\n ")]
