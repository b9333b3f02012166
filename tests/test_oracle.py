"""Every registered query with SQL equals it, at the smallest scale."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    result = check.compare(spark, con, SF_DIR, name, queries(), oracle_sql())
    assert result.startswith("ok"), result


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
