import numpy as np
import pytest
from conftest import curve, make_points

from pointlake.operators.agglomerate import _rounds, agglomerate
from pointlake.operators.knn_graph import knn_graph
from pointlake.workspace import Workspace


def labels(df):
    return {(r["shard"], r["root_id"], r["pid"]): r["cluster"] for r in df.select("shard", "root_id", "pid", "cluster").collect()}


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    objects = {(0, i): curve(n, i) for i, n in enumerate((1, 2, 4, 25, 60))} | {(1, 3): curve(40, 9)}
    # Features drift along the object, so neighbours resemble each other.
    features = {
        k: np.cumsum(rng.normal(size=(len(v), 6)) * 0.3, axis=0).astype("float32") + 1 for k, v in objects.items()
    }
    work = Workspace(spark)
    points = work.save(make_points(spark, objects, features), "points")
    return points, work.save(knn_graph(points, 3, work), "edges"), objects, features


@pytest.mark.parametrize(
    ("linkage", "metric", "threshold"), [("ward", "euclidean", 2.0), ("complete", "cosine", 0.05), ("complete", "euclidean", 1.5)]
)
def test_rounds_are_the_same_in_tasks_and_as_joins(spark, case, linkage, metric, threshold):
    points, edges, _, _ = case
    whole = agglomerate(points, edges, threshold, linkage, metric)
    assert whole.columns == [*points.columns, "cluster"]
    expected = labels(whole)
    assert 10 < len(set((*k[:2], v) for k, v in expected.items())) < len(expected) - 10
    # 30: large objects by component; 8: components above it run as joins.
    limit, hot_rows = (8, 5) if linkage == "ward" else (8, 1_000_000)
    assert labels(agglomerate(points, edges, threshold, linkage, metric, limit, hot_rows=hot_rows)) == expected


@pytest.mark.parametrize(("linkage", "metric", "threshold"), [("ward", "euclidean", 2.0), ("complete", "cosine", 0.05)])
def test_mutual_merges_are_the_same_in_tasks_and_as_joins(spark, case, linkage, metric, threshold):
    points, edges, _, _ = case
    expected = labels(agglomerate(points, edges, threshold, linkage, metric, merges="mutual"))
    assert labels(agglomerate(points, edges, threshold, linkage, metric, 8, merges="mutual")) == expected
    with pytest.raises(ValueError, match="merges"):
        agglomerate(points, edges, threshold, merges="some")


def naive_greedy(vectors, pairs, threshold):
    """Ward merges one closest linked pair at a time, recomputed from scratch each time."""
    groups = {i: [i] for i in range(len(vectors))}
    linked = {frozenset(p) for p in pairs}
    history, heights = [{k: list(v) for k, v in groups.items()}], []

    def height(a, b):
        x, y = vectors[groups[a]], vectors[groups[b]]
        gap = ((x.mean(0) - y.mean(0)) ** 2).sum()
        return np.sqrt(2 * len(x) * len(y) / (len(x) + len(y)) * gap)

    while linked:
        d, a, b = min((height(*sorted(p)), *sorted(p)) for p in linked)
        groups[a] = groups[a] + groups.pop(b)
        linked = {frozenset(a if x == b else x for x in p) for p in linked} - {frozenset([a])}
        heights.append(d)
        history.append({k: list(v) for k, v in groups.items()})
    undone = sum(h >= threshold for h in heights)
    rising = all(a <= b for a, b in zip(heights, heights[1:], strict=False))
    return ({tuple(sorted(g)) for g in history[len(heights) - undone].values()}, rising)


def naive_rounds(vectors, pairs, pid, threshold):
    """The documented ward rounds, recomputed from scratch each time."""
    groups = {i: [i] for i in range(len(vectors))}
    turn = 0
    while True:
        owner = {m: g for g, members in groups.items() for m in members}
        linked = {tuple(sorted((owner[a], owner[b]))) for a, b in pairs if owner[a] != owner[b]}
        near: dict[int, tuple[float, int]] = {}
        for a, b in linked:
            x, y = vectors[groups[a]], vectors[groups[b]]
            d = np.sqrt(2 * len(x) * len(y) / (len(x) + len(y)) * ((x.mean(0) - y.mean(0)) ** 2).sum())
            if d < threshold:
                for end, other in ((a, b), (b, a)):
                    near[end] = min(near.get(end, (np.inf, 0)), (d, other))
        if not near:
            return {tuple(sorted(g)) for g in groups.values()}
        asked = [tuple(sorted((a, b))) for a, (_, b) in near.items()]

        def rank(p):
            k, g = int(pid[p[0]]), int(pid[p[1]])
            turned = (k % 1000003 * 7919 + g % 1000003 * 104729 + turn * 15485863) % 1000003
            return (0 if asked.count(p) == 2 else 1 + turned, p)

        best = {e: min((rank(p) for p in asked if e in p)) for p in asked for e in p}
        for p in set(asked):
            if best[p[0]] == best[p[1]] == rank(p):
                groups[p[0]] = groups[p[0]] + groups.pop(p[1])
        turn += 1


def _random_case(seed, n=25):
    rng = np.random.default_rng(seed)
    vectors = np.cumsum(rng.normal(size=(n, 4)), axis=0)
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(12)}
    return vectors, sorted(pairs)


def _groups(owner):
    return {tuple(np.flatnonzero(owner == c).tolist()) for c in np.unique(owner)}


@pytest.mark.parametrize("seed", range(8))
def test_rounds_equal_a_naive_implementation(seed):
    vectors, pairs = _random_case(seed)
    pid = np.arange(len(vectors)) * 10**12 + seed
    src, dst = np.array(pairs).T
    for threshold in (1.0, 3.0, 6.0, 100.0):
        owner, _ = _rounds(src, dst, vectors, pid, threshold, "ward", "euclidean")
        assert _groups(owner) == naive_rounds(vectors, pairs, pid, threshold)


def test_rounds_mostly_agree_with_one_closest_pair_at_a_time():
    shares = []
    for seed in range(12):
        vectors, pairs = _random_case(seed, 60)
        src, dst = np.array(pairs).T
        owner, _ = _rounds(src, dst, vectors, np.arange(60), 3.0, "ward", "euclidean")
        label = {p: i for i, g in enumerate(naive_greedy(vectors, pairs, 3.0)[0]) for p in g}
        other = np.array([label[p] for p in range(60)])
        same = (owner[:, None] == owner[None, :]) == (other[:, None] == other[None, :])
        shares.append(same.mean())
    assert np.mean(shares) > 0.95


def test_mutual_merges_nearly_equal_one_closest_pair_at_a_time():
    """Paths of 30 points: how often the clusters are others, in all cases and where heights rise."""
    cases = rising = other = other_rising = 0
    for seed in range(150):
        rng = np.random.default_rng(seed)
        vectors = np.cumsum(rng.normal(size=(30, 8)), axis=0)
        src = np.arange(29)
        expected, rises = naive_greedy(vectors, list(zip(src, src + 1, strict=True)), 6.0)
        owner, _ = _rounds(src, src + 1, vectors, np.arange(30), 6.0, "ward", "euclidean", mutual=True)
        differs = _groups(owner) != expected
        cases, other = cases + 1, other + differs
        rising, other_rising = rising + rises, other_rising + (differs and rises)
    assert rising > 20 and other <= 0.08 * cases and other_rising <= 0.05 * rising


@pytest.mark.parametrize("linkage", ["ward", "complete"])
def test_shrinking_gaps_take_few_rounds(linkage):
    n = 2000
    gaps = np.linspace(2.0, 1.0, n - 1)
    vectors = np.concatenate([[0.0], np.cumsum(gaps)])[:, None]
    src = np.arange(n - 1)
    owner, turns = _rounds(src, src + 1, vectors, np.arange(n), 1e9, linkage, "euclidean")
    assert len(np.unique(owner)) == 1 and turns <= 40


def test_limits_are_explicit(spark, case):
    points, edges, _, _ = case
    with pytest.raises(ValueError, match="euclidean"):
        agglomerate(points, edges, 2.0, metric="cosine")
    with pytest.raises(ValueError, match="average"):
        agglomerate(points, edges, 2.0, linkage="average")
