import duckdb
import pandas as pd
import pytest

from pointlake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


def _rows(frame):
    return sorted(tuple(map(str, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, expected = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert isinstance(found, pd.DataFrame) and sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)
