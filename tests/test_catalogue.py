import duck
import pytest

from junctura.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return duck.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert duck.rows(got) == duck.rows(want)
