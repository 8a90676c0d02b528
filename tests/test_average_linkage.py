import numpy as np
import pandas as pd
import pytest

from pointlake.operators import average_linkage as linkage
from pointlake.operators.average_linkage import average_linkage
from pointlake.operators.reduce import principal_components

SF = "/root/testdata/sf0.01"


def naive(points, groups):
    """One closest pair at a time, by the mean of the distances of all their points."""
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    members = {i: [i] for i in range(len(points))}
    sums = far.copy()
    sizes = np.ones(len(points))
    mean = far.copy()
    np.fill_diagonal(mean, np.inf)
    while len(members) > groups:
        a, b = sorted(np.unravel_index(int(mean.argmin()), mean.shape))
        members[a] += members.pop(b)
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sizes[a] += sizes[b]
        mean[a] = sums[a] / (sizes[a] * sizes)
        mean[:, a] = mean[a]
        mean[a, a] = np.inf
        mean[b] = mean[:, b] = np.inf
        gone = [i for i in range(len(points)) if i not in members]
        mean[gone] = np.inf
        mean[:, gone] = np.inf
    ordered = sorted(members.values(), key=min)
    return {i: g for g, own in enumerate(ordered) for i in own}


def frame(spark, points):
    pdf = pd.DataFrame({"pid": range(len(points)), "v": points.tolist()})
    return spark.createDataFrame(pdf, "pid long, v array<double>").repartition(3)


@pytest.mark.parametrize(("seed", "n", "groups"), [(1, 60, 5), (2, 90, 20), (3, 40, 1)])
def test_groups_equal_one_closest_pair_at_a_time(spark, seed, n, groups):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 2)) + rng.integers(0, 4, (n, 1)) * 3
    rows = average_linkage(frame(spark, points), "v", "pid", groups).collect()
    assert {r["pid"]: r["label"] for r in rows} == naive(points, groups)


def test_groups_of_the_given_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    reduced = principal_components(vectors, "embedding", 2).select("vec_id", "reduced").orderBy("vec_id").toPandas()
    found = average_linkage(spark.createDataFrame(reduced), "reduced", "vec_id", 20).toPandas().sort_values("vec_id")
    expected = naive(np.stack(reduced["reduced"].to_numpy()), 20)
    assert found["label"].tolist() == [expected[i] for i in range(len(reduced))]


def test_few_rows_copies_and_nulls(spark):
    rows = [(1, [0.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, [5.0, 0.0], "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "pid long, v array<double>, label string")
    assert {r["pid"]: r["label"] for r in average_linkage(df, "v", "pid", 2).collect()} == {1: 0, 2: 0, 3: 1, 4: None}
    assert {r["pid"]: r["label"] for r in average_linkage(df, "v", "pid", 20).collect()} == {1: 0, 2: 1, 3: 2, 4: None}
    assert average_linkage(df.limit(0), "v", "pid", 2).count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        average_linkage(df, "v", "pid", 2, max_rows=2)


@pytest.mark.parametrize(("seed", "groups"), [(4, 12), (5, 1)])
def test_close_rows_merge_in_boxes_first(spark, monkeypatch, seed, groups):
    """With more rows than pairs may be stored of, copies and an outlier among them, the groups are the same."""
    monkeypatch.setattr(linkage, "MAX_CLUSTERS", 250)
    monkeypatch.setattr(linkage, "_FEW", 60)
    monkeypatch.setattr(linkage, "_BOX_CLUSTERS", 80)
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(400, 2)) + rng.integers(0, 4, (400, 1)) * 3
    points[300:340] = points[:40]
    points[17] = 40
    rows = average_linkage(frame(spark, points), "v", "pid", groups).collect()
    assert {r["pid"]: r["label"] for r in rows} == naive(points, groups)
