"""The operators that SQL can express, against it."""

import duckdb
import pytest

from clickwarden.llm.queries import QUERIES, SQL
from tests.test_oracle import rows


@pytest.mark.parametrize("name, size", [(name, size) for name in sorted(SQL) for size in ("sf0.001", "sf0.01")])
def test_query_matches_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    database = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        database.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    expected = database.execute(SQL[name]).df()
    found = QUERIES[name](spark, folder).toPandas()
    assert rows(found) == rows(expected) and len(found) > 0
