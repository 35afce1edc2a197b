"""Every registered query of the library proper against DuckDB."""

import pytest
from oracle import compare
from tableloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, query_sf, name):
    df = registry.QUERIES[name](spark, query_sf)
    if name in registry.ORACLE_SQL:
        compare(df, registry.ORACLE_SQL[name], query_sf)
    else:
        df.count()
