from pathlib import Path

import pytest

import __spark_entry__ as entry
import check
from rollspan.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")

# Wide fits, whose short forms have twins, the design's conditioning and raw file digests.
WITHOUT_TWIN = {
    "f6_nlinear_fit_months", "f7_nlinear_predict_months", "f8_nlinear_selection_months",
    "f11_conditioning_months", "s15_file_digests",
}


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_TWIN
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name", ["w2_windows", "f4_ar1", "v5_window_contract", "q3_decay", "c6_cohort_selection"]
)
def test_twins_agree(spark, name):
    import duckdb

    database = duckdb.connect()
    for table in check.TABLES:
        database.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = database.execute(entry.oracle_sql()[name]).df()
    assert check.normal(got) == check.normal(want)
