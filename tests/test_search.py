import numpy as np
import pandas as pd
import pytest

from pointlake.operators import batched_search
from pointlake.operators.batched_search import nearest_many, search_many, visited_cells
from pointlake.operators.reduce import group_vectors, principal_components
from pointlake.operators.search import VectorIndex, build_index, nearest
from pointlake.workspace import Workspace

DIMS = 16


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, DIMS)) * 4
    rows = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, DIMS))).astype("float32")
    rows[7] = rows[3]
    frame = pd.DataFrame({"vec_id": range(1500), "embedding": list(rows.tolist())})
    path = str(tmp_path_factory.mktemp("vectors") / "t")
    spark.createDataFrame(frame, "vec_id long, embedding array<float>").write.parquet(path)
    return spark.read.parquet(path), rows


def exact(rows, query, k):
    far = ((rows.astype("float64") - np.asarray(query, "float64")) ** 2).sum(axis=1)
    return np.argsort(far, kind="stable")[:k].tolist()


def test_nearest_is_exact(spark, vectors):
    df, rows = vectors
    found = nearest(df, "embedding", rows[3].tolist(), 10, ["vec_id"])
    assert [r["vec_id"] for r in found.orderBy("distance", "vec_id").collect()] == exact(rows, rows[3], 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_index_finds_most_and_all_with_full_probe(spark, vectors, tmp_path):
    df, rows = vectors
    built = build_index(df, str(tmp_path / "index"), "embedding", ["vec_id"], DIMS, cells=12, parts=4, codes=32)
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    np.testing.assert_allclose(index.centres, built.centres)
    recalls = []
    for i in range(0, 60, 10):
        query = rows[i].tolist()
        near = {r["vec_id"] for r in index.search(spark, query, 20, nprobe=3, refine=5).collect()}
        recalls.append(len(near & set(exact(rows, query, 20))) / 20)
    assert np.mean(recalls) > 0.9
    full = index.search(spark, rows[0].tolist(), 20, nprobe=12, refine=75)
    assert [r["vec_id"] for r in full.orderBy("distance", "vec_id").collect()] == exact(rows, rows[0], 20)
    plan = index.search(spark, rows[0].tolist(), 20, nprobe=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell" in plan.split("PartitionFilters")[1][:80]


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    return build_index(vectors[0], path, "embedding", ["vec_id"], DIMS, cells=12, parts=4, codes=32)


def _queries(spark, rows, ids):
    frame = pd.DataFrame({"query_id": ids, "query": [rows[i].tolist() for i in ids]})
    return spark.createDataFrame(frame, "query_id long, query array<float>")


def _by_query(found):
    lists = {}
    for r in found.orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
    return lists


@pytest.mark.parametrize("block", [4096, 37])
def test_many_queries_are_exact(spark, vectors, index, monkeypatch, block):
    """Also where cells are dealt into many blocks on both sides, and with copies of a vector."""
    monkeypatch.setattr(batched_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(batched_search, "BLOCK_QUERIES", block)
    df, rows = vectors
    ids = [*range(0, 1500, 25), 7]
    found = _by_query(nearest_many(index, _queries(spark, rows, ids), 10))
    assert found == {i: exact(rows, rows[i], 10) for i in ids}


def test_far_queries_and_more_rows_than_there_are(spark, vectors, index):
    df, rows = vectors
    odd = np.vstack([rows[:1] * 0, rows[:1] * 50, rows[:1] + 1000]).astype("float32")
    found = _by_query(nearest_many(index, _queries(spark, odd, [0, 1, 2]), 30))
    assert found == {i: exact(rows, odd[i], 30) for i in range(3)}
    everything = _by_query(nearest_many(index, _queries(spark, rows, [3]), 2000))
    assert everything == {3: exact(rows, rows[3], 1500)}
    none = spark.createDataFrame([(1, None)], "query_id long, query array<float>")
    assert nearest_many(index, none, 5).count() == search_many(index, none, 5).count() == 0


def test_most_cells_are_skipped(spark, vectors, index):
    """On clustered data few cells are within the bound; the rest are never compared."""
    df, rows = vectors
    work, queries = Workspace(spark), _queries(spark, rows, list(range(0, 1500, 50)))
    first, later = visited_cells(index, queries, 10, "query_id", "query", work)
    near = nearest_many(index, queries, 10).groupBy("query_id").agg({"distance": "max"}).withColumnRenamed("max(distance)", "far")
    rest = later(queries.join(near, "query_id").selectExpr("query_id", "query", "far * far AS bound"))
    assert (first.count() + rest.count()) / (30 * 12) < 0.35


def test_many_queries_through_the_codes(spark, vectors, index):
    df, rows = vectors
    ids = list(range(0, 1500, 25))
    found = _by_query(search_many(index, _queries(spark, rows, ids), 20, nprobe=3, refine=5))
    recalls = [len(set(found[i]) & set(exact(rows, rows[i], 20))) / 20 for i in ids]
    assert np.mean(recalls) >= 0.9 and all(len(v) == 20 for v in found.values())
    full = _by_query(search_many(index, _queries(spark, rows, ids), 20, nprobe=12, refine=75))
    assert full == {i: exact(rows, rows[i], 20) for i in ids}


def test_short_lists_lose_no_row_of_a_crowded_cell(spark, vectors, tmp_path):
    """Two codes a part tell few rows apart; every row of the probed cells counts all the same."""
    df, rows = vectors
    index = build_index(df, str(tmp_path / "coarse"), "embedding", ["vec_id"], DIMS, cells=2, parts=4, codes=2)
    ids = list(range(0, 1500, 25))
    found = _by_query(search_many(index, _queries(spark, rows, ids), 10, nprobe=2, refine=1, lossless=True))
    assert found == {i: exact(rows, rows[i], 10) for i in ids}


def test_index_refuses_uneven_parts(spark, vectors, tmp_path):
    with pytest.raises(ValueError, match="equal parts"):
        build_index(vectors[0], str(tmp_path / "x"), "embedding", ["vec_id"], DIMS, parts=5)


def test_components_match_a_decomposition(spark, vectors):
    df, rows = vectors
    found = principal_components(df, "embedding", 3).orderBy("vec_id").toPandas()
    mine = np.abs(np.stack(found["reduced"]))
    centred = rows.astype("float64") - rows.astype("float64").mean(axis=0)
    _, _, basis = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(mine, np.abs(centred @ basis[:3].T), atol=1e-6)


def test_groups(spark, vectors):
    grouped = group_vectors(vectors[0], "embedding", 12)
    counts = grouped.groupBy("label").count().collect()
    assert len(counts) == 12 and sum(r["count"] for r in counts) == 1500
