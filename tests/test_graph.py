import pathlib

import numpy as np
import pytest
from conftest import brute_edges, curve, make_points
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake.operators import knn_graph as module
from pointlake.operators.components import connected_components, smallest_reachable
from pointlake.operators.knn_graph import knn_graph, nearest_neighbours
from pointlake.workspace import Workspace


def edge_set(df):
    return {tuple(r) for r in df.select("shard", "root_id", "src", "dst").collect()}


def _mixed():
    rng = np.random.default_rng(3)
    spot = np.array([[5.0, 5.0, 5.0]])
    return {
        (0, 1): rng.normal(size=(1, 3)),
        (0, 2): rng.normal(size=(2, 3)),
        (0, 3): rng.normal(size=(3, 3)),
        (0, 4): rng.normal(size=(4, 3)),
        (0, 123456789012345678): curve(400, 1) * 1000,
        (1, 123456789012345678): curve(60, 2),
        # copies of one location, a few and very many
        (1, 5): np.repeat(spot, 3, axis=0),
        (1, 6): np.vstack([np.repeat(spot, 200, axis=0), rng.normal(size=(50, 3))]),
        # a lone point beside a dense cluster, and two dense clusters far apart
        (2, 7): np.vstack([rng.normal(size=(300, 3)) * 1e-3, [[1e4, 0, 0]]]),
        (2, 8): np.vstack([rng.normal(size=(80, 3)), rng.normal(size=(80, 3)) + 1e6]),
        # a regular grid: many ties
        (2, 9): np.stack(np.meshgrid(*[np.arange(5.0)] * 3), axis=-1).reshape(-1, 3),
    }


@pytest.mark.parametrize("k", [1, 3, 10])
def test_graph_equals_brute_force(spark, k):
    objects = _mixed()
    assert edge_set(knn_graph(make_points(spark, objects), k)) == brute_edges(objects, k)


def test_hot_object_and_many_copies_by_joins(spark, monkeypatch):
    monkeypatch.setattr(module, "_BROADCAST_ROWS", 0)
    objects = _mixed()
    neighbours = nearest_neighbours(make_points(spark, objects), 3, hot_rows=10)
    assert edge_set(module.undirected(neighbours)) == brute_edges(objects, 3)


def test_copies_do_not_make_a_hub(spark):
    edges = knn_graph(make_points(spark, {(0, 0): np.vstack([np.zeros((500, 3)), curve(20, 1) + 1])}), 3)
    degree = module.both_directions(edges).groupBy("src").count().agg(F.max("count")).first()[0]
    assert degree <= 2 * 3 + 3 * 12


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.sampled_from([-2.0, -0.5, 0.0, 0.1, 3.0, 1e7])] * 3), min_size=1, max_size=40))
def test_graph_on_awkward_coordinates(spark, points):
    objects = {(0, 0): np.array(points)}
    assert edge_set(knn_graph(make_points(spark, objects), 3)) == brute_edges(objects, 3)


def test_missing_coordinate_is_refused(spark):
    points = make_points(spark, {(0, 0): curve(5, 0)}).withColumn("x", F.when(F.col("pid") != 2, F.col("x")))
    with pytest.raises(ValueError, match="1 points"):
        knn_graph(points)


def stored_search(spark, work):
    (path,) = pathlib.Path(work.path.removeprefix("file:")).glob("*-search")
    return spark.read.parquet(str(path))


def test_candidates_do_not_grow_with_the_object(spark):
    """Compared pairs per point stay level when an object gets ten times larger."""

    def pairs(n):
        work = module.Workspace(spark)
        found = nearest_neighbours(make_points(spark, {(0, 0): curve(n, 5)}), 3, work)
        found.write.format("noop").mode("overwrite").save()
        searched = stored_search(spark, work).filter("level > -5000").toPandas()
        xyz = searched[["x", "y", "z"]].to_numpy()
        sides = 2.0 ** searched["level"].to_numpy()
        return np.mean([
            (np.abs(xyz - p) <= s).all(axis=1).sum() for p, s in zip(xyz[::17], sides[::17], strict=True)
        ])

    small, large = pairs(300), pairs(3000)
    assert large < 2 * small


def union_find(n, edges):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return [root(i) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(*[st.integers(0, n - 1)] * 2)))))
def test_smallest_reachable(case):
    n, edges = case
    src, dst = (np.array([e[i] for e in edges], dtype=int) for i in (0, 1))
    assert smallest_reachable(n, src, dst).tolist() == union_find(n, edges)


@pytest.mark.parametrize(("max_edges", "hot_rows"), [(1_000_000, 1_000_000), (15, 1_000_000), (15, 3)])
def test_components_equal_union_find(spark, max_edges, hot_rows):
    rng = np.random.default_rng(8)
    n = 120
    path = [(i, i + 1) for i in range(0, 50)]
    star = [(60, i) for i in range(61, 100)]
    loose = [tuple(sorted(rng.choice(20, 2, replace=False) + 100)) for _ in range(8)]
    rows = [(0, 0, a, b) for a, b in [*path, *star, *loose]] + [(0, 1, 0, 1), (0, 1, 2, 3)]
    rows = [tuple(map(int, r)) for r in rows]
    edges = spark.createDataFrame(rows, "shard long, root_id long, src long, dst long")
    points = make_points(spark, {(0, 0): np.zeros((n, 3)), (0, 1): np.zeros((5, 3))})
    found = connected_components(points, edges, max_object_edges=max_edges, hot_rows=hot_rows)
    labels = {(r["root_id"], r["pid"]): r["component"] for r in found.collect()}
    expected = {(0, i): c for i, c in enumerate(union_find(n, [r[2:] for r in rows if r[1] == 0]))}
    expected |= {(1, i): c for i, c in enumerate([0, 0, 2, 2, 4])}
    assert labels == expected


def test_a_far_point_does_not_coarsen_the_search(spark):
    """Candidate pairs stay about as many when another object has a point far away."""
    rng = np.random.default_rng(8)
    near = rng.normal(size=(3000, 3))

    def level_pairs(objects):
        work = Workspace(spark)
        found = knn_graph(make_points(spark, objects), 3, work)
        cells = stored_search(spark, work).filter("level > -5000").select(
            "root_id", "level", *[F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).alias(c) for c in "xyz"]
        )
        return cells.groupBy("root_id", "level", "x", "y", "z").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0], found

    alone, _ = level_pairs({(0, 1): near})
    beside, found = level_pairs({(0, 1): near, (0, 2): np.array([[0.0, 0, 0], [1e7, 1e7, 1e7]])})
    assert beside < 1.5 * alone
    within = {(0, 1): np.vstack([near[:400], [[1e9, -1e9, 1e9]]])}
    edges = {tuple(r) for r in knn_graph(make_points(spark, within), 3).collect()}
    assert edges == brute_edges(within)


def test_few_points_are_searched_alone(spark):
    """Points at the ends of batches and partitions, with ids in no order along the curve."""
    rng = np.random.default_rng(9)
    objects = {(0, 1): rng.permutation(curve(2500, 3)), (0, 2): curve(3, 4), (1, 1): rng.normal(size=(40, 3))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        work = Workspace(spark)
        edges = {tuple(r) for r in knn_graph(make_points(spark, objects), 3, work).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert edges == brute_edges(objects)
    alone = stored_search(spark, work).filter("level = -5000 AND shard = 0 AND root_id = 1").count()
    assert alone <= 6
