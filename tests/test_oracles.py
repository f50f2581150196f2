"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.LLM_QUERIES}
#: These find nothing in the smallest tables; any other empty result is a failure.
EMPTY_HERE = {"having_no_current", "spatial_join_intersects_mean", "idw_adaptive", "idw_grid", "validate_interpolation", "scan_station_values"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    state, rows, _, info = compare(spark, con, name, entry.queries()[name], ORACLES[name], FOLDER)
    assert state == ("EMPTY" if name in EMPTY_HERE else "ok"), info


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "id_recinto"
