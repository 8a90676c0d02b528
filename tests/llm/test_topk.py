import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm.topk import exact_top_k, scaled_ints

SCHEMA = "vec_id long, ints array<long>, score string"


def _brute(rows, asked, k):
    out = set()
    for q, v in asked:
        scored = sorted((-int(np.dot(np.array(v, dtype=object), np.array(w, dtype=object))), i) for i, w in rows if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("size", [3, 10**6, 10**8])
@pytest.mark.parametrize("block", [4, 1000])
def test_against_brute_force(spark, size, block):
    rng = np.random.default_rng(size)
    rows = [(i, rng.integers(-size, size, 8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # many equal scores
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    found = exact_top_k(table, table.filter(F.col("vec_id") % 20 == 0), 10, block_queries=block)
    assert {tuple(r) for r in found.collect()} == _brute(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_few_rows_nulls_and_repeats(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [3, 4]), (1, [3, 4]), (2, None), (None, [1, 1]), (3, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = exact_top_k(table, table.filter("vec_id = 0"), 5).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 11), (0, 2, 1, 11)]
    assert exact_top_k(table, table.limit(0)).count() == 0
    assert exact_top_k(table.limit(0), table).count() == 0


def test_components_are_floored_or_the_vector_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.0001],), ([nan, 1.0],), ([1.0, None],), ([-inf, 1.0],), (None,)]
    got = spark.createDataFrame(rows, "v array<float>").select(scaled_ints("v").alias("i")).collect()
    assert [r["i"] for r in got] == [[512, -1], None, None, None, None]


@pytest.mark.parametrize("odd", [[[1, 2, 3], [1, 2, 3, 4, 5]], [[9], [1, 1, 1, 1, 1, 1, 1]]])
def test_other_lengths_are_an_error(spark, odd):
    """Also where the lengths of a batch add up to whole vectors."""
    rows = [(0, [1, 2, 3, 4]), (5, [4, 3, 2, 1])] + [(i + 1, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="components"):
        exact_top_k(table, table.filter("vec_id = 0"), 3).collect()
