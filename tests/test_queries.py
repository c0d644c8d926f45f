import pytest

import __spark_entry__ as entry
from compare import compare, oracle

CHECKED = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(folder):
    return oracle(folder)


def test_every_oracle_has_a_query():
    assert set(CHECKED) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, folder, name):
    assert compare(spark, duck, folder, name) == ""


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
