"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from scripts.compare import connect, differences  # noqa: E402

from ringloom import workload  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(workload.queries()) == set(workload.oracle_sql())
    assert set(workload.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query_equals_sql(spark, con, name):
    _, problems = differences(spark, con, SMALL, name)
    assert not problems
