import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from pointlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(frame: pd.DataFrame):
    def shown(value):
        if pd.isna(value):
            return "null"
        return value if isinstance(value, str) else f"{float(value):.9g}"

    return sorted(tuple(shown(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    result = contract.queries()[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = result.toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    expected = connection.execute(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_agglomeration_ratio_is_a_share(spark):
    ratio = contract.queries()["agglomerate_ratio"](spark, SF).first()["ratio"]
    assert 0 < ratio < 1 and not math.isnan(ratio)


def test_sum_of_squares_beyond_a_long(spark, tmp_path):
    """The sum of two squares that no long holds is still the exact one; a smaller one stays a long."""
    for name, keys in (("large", [3_000_000_001, 2_999_999_999]), ("small", [3, 4])):
        spark.createDataFrame([(k,) for k in keys], "l_partkey long").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found = contract.queries()["sum_squares"](spark, f"{tmp_path}/{name}")
        assert [int(r["sum_squares"]) for r in found.collect()] == [sum(k * k for k in keys)]
        assert found.dtypes == [("sum_squares", "decimal(38,0)" if name == "large" else "bigint")]


@pytest.mark.parametrize("name", ["ann_ivf", "ann_recall"])
def test_index_queries_on_crowded_vectors(spark, tmp_path, name):
    """The queries and the vectors added later lie so close together that codes hardly tell them apart."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 64)) * 10
    close = (np.arange(3000) % 2 == 1) | (np.arange(3000) % 100 == 0)
    rows[close] = 3 + rng.normal(size=(close.sum(), 64)) * 1e-2
    frame = pd.DataFrame({"vec_id": range(3000), "embedding": rows.astype("float32").tolist()})
    spark.createDataFrame(frame, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert _rows(contract.queries()[name](spark, str(tmp_path)).toPandas()) == _rows(con.execute(contract.oracle_sql()[name]).df())
