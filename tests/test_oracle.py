"""Every registered query against its SQL, at two sizes."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from clickwarden.plans import batch, streams

DATA = Path("/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def rows(frame):
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or value != value:
            return ""
        return f"{value:.9g}" if isinstance(value, float) and not math.isinf(value) else str(value)

    return columns, sorted(tuple(plain(value) for value in row)
                           for row in frame[columns].itertuples(index=False, name=None))


QUERIES = {**batch.QUERIES, **streams.QUERIES}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name, size", [
    (name, size) for name in sorted(QUERIES) for size in ("sf0.001", "sf0.01")
    if size == "sf0.01" or not name.startswith("stream_")])
def test_query_matches_sql(spark, name, size):
    folder = DATA / size
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    expected = database.execute(contract.oracle_sql()[name]).df()
    found = QUERIES[name](spark, str(folder)).toPandas()
    assert rows(found) == rows(expected)
    if size == "sf0.01":
        assert len(found) > 0


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "ip", "window_start", "window_end", "reasons", "n_events", "clicks", "views", "n_categories"]
