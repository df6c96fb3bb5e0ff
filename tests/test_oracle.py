"""Every registered query of the library, against DuckDB where it has SQL."""

import pytest

from scholarlake import catalog
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in catalog.oracle_sql():
        compare(df, catalog.oracle_sql()[name], con)
    else:
        assert df.count() > 0
    spark.catalog.clearCache()
