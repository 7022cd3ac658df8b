"""Every registered query at the smallest scale: exact against its SQL, or at least non-empty without one."""

import pytest

import __spark_entry__ as driver
from cotejo.catalog import registry
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
QUERIES, SQL = {n: driver.queries()[n] for n in registry()}, driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert oracle.compare(df, SQL[name], con) is None
    else:
        assert not df.isEmpty()


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["form_id", "part", "pos", "outcome", "id_number", "confidence"]
    assert df.count() > 0
