"""Every registered query against its DuckDB text."""
import pytest

from archlens import registry
from tests import oracle
from tests.conftest import SF

registry.load()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query(spark, duck, key):
    ok, note = oracle.compare(spark, duck, key, SF)
    assert ok, note
