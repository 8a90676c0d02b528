from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from pointlake.operators.batched_search import nearest_many, search_many
from pointlake.operators.index_upkeep import maintain, regrouped_cells
from pointlake.operators.search import VectorIndex, build_index

DIMS = 16


def _frame(spark, rows, first=0):
    pdf = pd.DataFrame({"vec_id": range(first, first + len(rows)), "embedding": rows.astype("float32").tolist()})
    return spark.createDataFrame(pdf, "vec_id long, embedding array<float>")


def _files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet")}


def _recall(spark, index, rows, ids, k=10):
    queries = spark.createDataFrame(pd.DataFrame({"query_id": ids, "query": [rows[i].tolist() for i in ids]}), "query_id long, query array<float>")
    found = search_many(index, queries, k, nprobe=4, refine=8).select("query_id", "vec_id")
    exact = nearest_many(index, queries, k).select("query_id", "vec_id")
    hits = {(r[0], r[1]) for r in found.collect()} & (truth := {(r[0], r[1]) for r in exact.collect()})
    far = ((rows[None, :].astype("float64") - rows[ids][:, None].astype("float64")) ** 2).sum(axis=2)
    brute = {(i, int(j)) for i, row in zip(ids, far, strict=True) for j in np.argsort(row, kind="stable")[:k]}
    assert truth == brute
    return len(hits) / len(truth)


@pytest.fixture(scope="module")
def drifted(spark, tmp_path_factory):
    """An index of one distribution, to which twice as many rows of another one are appended."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, DIMS)) * 3
    old = centres[rng.integers(0, 10, 1000)] + rng.normal(size=(1000, DIMS))
    new = rng.normal(size=(40, DIMS))[rng.integers(0, 40, 2000)] * 6 + 60 + rng.normal(size=(2000, DIMS)) * 0.7
    rows = np.concatenate([old, new]).astype("float32")
    path = str(tmp_path_factory.mktemp("upkeep") / "index")
    build_index(_frame(spark, old), path, "embedding", ["vec_id"], DIMS, cells=10, parts=4, codes=32)
    index = VectorIndex.load(spark, path)
    index.append(_frame(spark, rows[1000:], 1000))
    return index, rows


def test_recall_returns_after_rows_of_another_distribution(spark, drifted):
    index, rows = drifted
    asked = list(range(1000, 3000, 40)) + list(range(0, 1000, 100))
    before, names = _recall(spark, index, rows, asked), _files(index.path)
    kept = maintain(spark, index)
    assert before < 0.8 and _recall(spark, kept, rows, asked) >= 0.9
    loaded = VectorIndex.load(spark, index.path)
    assert loaded.live.tolist() == kept.live.tolist() and len(loaded.books) == 2
    found = sorted(r["vec_id"] for r in loaded.rows(spark).select("vec_id").collect())
    assert found == list(range(3000))
    # Cells that are still in use were not written again, and retired ones are gone.
    alive = {f"cell={c}" for c in np.flatnonzero(loaded.live)}
    after = _files(index.path)
    old = {f for f in names if f.split("/")[0] in alive}
    assert old and old <= after and {f.split("/")[0] for f in after} <= alive
    assert {f for f in names - old} & after == set()
    best = loaded.search(spark, rows[1500].tolist(), 5, nprobe=4, refine=10).collect()
    assert best[0]["vec_id"] == 1500
    settled = _files(index.path)
    assert maintain(spark, loaded, crowded=100, wide=100, sparse=0) is loaded and _files(index.path) == settled
    again = maintain(spark, loaded)
    assert _recall(spark, again, rows, asked) >= 0.9 and again.rows(spark).count() == 3000


def test_which_cells_are_regrouped():
    line = np.arange(6.0)[:, None]
    index = VectorIndex("p", "v", ["i"], line, [], np.array([1, 1, 1, 1, 1, 0], bool), np.zeros(6, np.int64))
    counts, far = np.array([100, 100, 2, 400, 100, 0]), np.array([1.0, 1, 1, 1, 5, 0])
    assert regrouped_cells(index, counts, far) == [([1, 2], 1), ([3], 3), ([4], 2)]
    assert regrouped_cells(index, np.full(6, 100), np.ones(6)) == []
    assert regrouped_cells(index, np.zeros(6, np.int64), np.zeros(6)) == []
