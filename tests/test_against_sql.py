"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks import REGISTRY
from checks.compare import compare
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_same_rows(spark, duck, name):
    ok, note = compare(spark, duck, REGISTRY[name], SMALL)
    assert ok, note


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["instruction", "input", "output", "source_md", "chunk_index"]
