"""Every query of the engine against its DuckDB text."""

import pytest
from groundphrase.plans import catalog
from oracle import same, spark_rows

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(catalog.queries()[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, name):
    spark_rows(catalog.queries()[name](spark, SF))
