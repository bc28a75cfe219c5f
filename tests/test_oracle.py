"""Every registered query against its DuckDB statement (the driver's correctness gate).

Runs at sf0.001 by default; CHRONOSCOPE_ORACLE_SF overrides the folder."""

import os

import pytest

from paths import SF001

import __spark_entry__ as E
from oracle_harness import compare

SF = os.environ.get("CHRONOSCOPE_ORACLE_SF", SF001)


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF, None, verbose=False)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(results, name):
    status = results[name]
    assert status[0] in ("ok", "rows-only"), status


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "method" in df.columns
