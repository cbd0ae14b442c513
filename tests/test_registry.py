"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, connect, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


# Queries of the text operators have tests of their own.
TEXT = set(registry.llm.queries()) | {"pipeline"} if registry.llm else set()
NAMES = [name for name in registry.queries() if name not in TEXT]


def test_every_query_has_its_sql():
    assert set(NAMES) == registry.oracle_sql().keys() - TEXT


def test_entry(spark):
    assert registry.entry(spark).columns == ["start", "group", "count"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    good, text = compare(spark, database, name, FOLDER)
    assert good, text
