"""Every registered query beside its SQL twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_twins import compare, duck  # noqa: E402

from roadframes.plans.catalog import QUERIES, TWINS  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_twin(spark, con, name):
    said = compare(spark, con, name, QUERIES[name], TWINS.get(name), SF)
    assert said.startswith(("ok", "rows only")), said
    assert not said.endswith(" 0"), "no rows"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
