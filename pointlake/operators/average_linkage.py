"""Average linkage of points into a number of groups, on a distributed matrix of distance sums.

The matrix has a row for every cluster with the sum of distances to every other one; its
rows are spread over tasks and stored anew after each round of merges. In a round every
cluster whose nearest one has it as nearest merges with that. Average linkage never makes
a cluster nearer to a merged pair than to both of its halves, so such pairs merge in any
order of merging, many can go in a round, and the heights alone say where to cut.

The matrix of many points would be too large, so close ones merge before it is made, in
boxes: the mean distance of two clusters is no less than that of their centres, so a
cluster nearer to another one than to the walls of its box has no nearer one outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.workspace import Workspace

# The driver and each task hold a few numbers for each row.
MAX_ROWS = 1_000_000
# The matrix takes 8 bytes for every pair of clusters that are left for it.
MAX_CLUSTERS = 100_000
# So many clusters go to the matrix without boxes; at most so many clusters, and points, in a box.
_FEW = 8192
_BOX_CLUSTERS = 2048
_BOX_POINTS = 32_768
_ROW = "id long, sums array<double>"


def _rows(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * matrix.shape[1]
    sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids), sums], names=["id", "sums"])


def _read(batch: pa.RecordBatch, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of a batch, some at a time."""
    step = max(1, 4_000_000 // max(held, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, held)


def average_linkage(
    df: DataFrame, vector: str, pid: str, groups: int = 20, name: str = "label", max_rows: int = MAX_ROWS, work: Workspace | None = None
) -> DataFrame:
    """``df`` with the number of each row's group, from 0 in the order of their smallest ``pid``.

    The groups are those of a full average linkage tree over euclidean distances, cut
    where ``groups`` are left; of equal distances the pair with smaller ids merges first.
    Rows without a vector have no group. Ids have to be unique.

    Close clusters of many rows merge in boxes first. The distances of all pairs of those
    left are then stored, 8 bytes each, and read once a round; rounds are few, as about a
    third of the clusters merge in each. All pairs of rows are measured once, whatever the
    number of clusters. More than ``max_rows`` rows are refused: ``group_vectors`` groups
    any number of rows, by another algorithm.
    """
    spark = df.sparkSession
    work = work or Workspace(spark)
    points = df.select(pid, F.col(vector).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    n = points.count()
    if n > max_rows:
        raise ValueError(f"{n} rows are more than {max_rows}, which the driver holds")
    if not n:
        return df.withColumn(name, F.lit(None).cast("int"))
    # A bounded number of points.
    held = points.toArrow().sort_by(pid)
    matrix = held["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    labels = _cut(n, _merges(spark, matrix, groups, work), groups)
    named = spark.createDataFrame(pa.table({"_id": held[pid], name: pa.array(labels, pa.int32())}))
    return df.drop(name).join(named, F.col(pid) == F.col("_id"), "left").drop("_id")


def _boxes(centres: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the clusters of each box, and its walls: halves of halves along the widest side."""
    whole = np.full(centres.shape[1], np.inf)
    todo = [(np.arange(len(centres)), -whole, whole)]
    while todo:
        own, low, high = todo.pop()
        spread = np.ptp(centres[own], axis=0)
        axis = int(spread.argmax())
        if len(own) <= _BOX_CLUSTERS and counts[own].sum() <= _BOX_POINTS or not spread[axis] > 0:
            if 1 < len(own) <= _BOX_CLUSTERS:  # clusters about the same centre wait for the matrix
                yield own, low, high
            continue
        values = centres[own, axis]
        below = values < np.median(values)
        if not below.any():
            below = values == values.min()
        wall = (values[below].max() + values[~below].min()) / 2
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = wall
        todo += [(own[below], low, left), (own[~below], right, high)]


def _sums_between(own: np.ndarray, weights: np.ndarray, points: np.ndarray, all_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the distances of points to all clusters, whose points come one after the other from ``starts``."""
    total = np.zeros(len(starts))
    step = max(1, 2_000_000 // len(points))
    for at in range(0, len(own), step):
        square = np.zeros((len(own[at : at + step]), len(points)))
        for d in range(points.shape[1]):
            square += (own[at : at + step, d, None] - points[None, :, d]) ** 2
        total += np.add.reduceat((weights[at : at + step] @ np.sqrt(square, out=square)) * all_weights, starts)
    return total


def _merges_in_box(ids: np.ndarray, points: np.ndarray, weights: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Task helper: ``(height, kept, gone)`` of merges that no cluster outside the box can change."""
    ends = np.append(starts[1:], len(points))
    sizes, moments = np.add.reduceat(weights, starts), np.add.reduceat(points * weights[:, None], starts, axis=0)
    sums = np.stack([_sums_between(points[a:b], weights[a:b], points, weights, starts) for a, b in zip(starts, ends, strict=True)])
    while True:
        every = np.arange(len(ids))
        mean = sums / (sizes[:, None] * sizes)
        mean[every, every] = np.inf
        near = mean.argmin(axis=1)
        height, centres = mean[every, near], moments / sizes[:, None]
        # Less what rounding may add.
        wall = np.minimum(centres - low, high - centres).min(axis=1) * (1 - 1e-9) - 1e-12 * np.abs(centres).max(axis=1)
        sure = height < wall
        first = np.flatnonzero((near[near] == every) & (near > every) & sure & sure[near])
        if not len(first):
            return
        second = near[first]
        yield height[first], ids[first], ids[second]
        sums[first] += sums[second]
        sums[:, first] += sums[:, second]
        sizes[first] += sizes[second]
        moments[first] += moments[second]
        stay = np.setdiff1d(every, second)
        sums, sizes, moments, ids = sums[np.ix_(stay, stay)], sizes[stay], moments[stay], ids[stay]


def _merges(spark, points: np.ndarray, groups: int, work: Workspace) -> list[tuple[float, int, int]]:
    """``(height, kept, gone)`` of merges, at least all that the cut needs."""
    n = len(points)
    if n <= groups:
        return []
    # Points of clusters one after the other: coordinates, copies and clusters, named by their first row.
    weights, owner = np.ones(n), np.arange(n)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n > _FEW:
        _, first, which, copies = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
        keeper = first[which.ravel()]
        gone = np.flatnonzero(keeper != np.arange(n))
        gone = gone[np.argsort(keeper[gone], kind="stable")]
        done.append((np.zeros(len(gone)), keeper[gone], gone))
        by = np.argsort(first)
        owner, weights = first[by], copies[by].astype("float64")
        points = points[owner]
    while True:
        order = np.argsort(owner, kind="stable")
        owner, points, weights = owner[order], points[order], weights[order]
        live, starts, counts = np.unique(owner, return_index=True, return_counts=True)
        if len(live) <= _FEW:
            break
        sizes = np.add.reduceat(weights, starts)
        centres = np.add.reduceat(points * weights[:, None], starts, axis=0) / sizes[:, None]
        boxes = list(_boxes(centres, counts))
        shared = spark.sparkContext.broadcast((points, weights, live, starts, counts, boxes))

        def in_boxes(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            points, weights, live, starts, counts, boxes = shared.value
            for batch in batches:
                for box in batch.column(0).to_pylist():
                    own, low, high = boxes[box]
                    own = np.sort(own)
                    at = np.concatenate([np.arange(starts[c], starts[c] + counts[c]) for c in own])
                    begin = np.cumsum(counts[own]) - counts[own]
                    for merged in _merges_in_box(live[own], points[at], weights[at], begin, low, high):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], names=["height", "kept", "gone"])

        found = spark.range(0, len(boxes), 1, max(len(boxes), 1)).mapInArrow(in_boxes, "height double, kept long, gone long")
        found = [c.to_numpy() for c in found.toArrow().columns]
        shared.destroy()
        done.append(tuple(found))
        into = np.arange(n)
        into[found[2]] = found[1]
        while (into[into] != into).any():
            into = into[into]
        owner = into[owner]
        if len(found[0]) < len(live) / 20:
            break
    live, starts = np.unique(owner, return_index=True)
    if len(live) > MAX_CLUSTERS:
        raise ValueError(f"{len(live)} clusters are more than {MAX_CLUSTERS}, whose pairs are stored")
    if (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        owner, points, weights = owner[order], points[order], weights[order]
        live, starts = np.unique(owner, return_index=True)
    sizes = np.add.reduceat(weights, starts)
    merges = [(float(h), int(a), int(b)) for part in done for h, a, b in zip(*part, strict=True)]
    rows = work.save(_matrix(spark, points, weights, live, starts), "sums")
    while len(live) > 1:
        at, near, height = _nearest(rows, live, sizes)
        lowest = np.sort([h for h, *_ in merges])
        if len(lowest) >= n - groups and lowest[n - groups - 1] <= height.min():
            break  # no later merge is lower
        mutual = np.flatnonzero((near[near] == np.arange(len(live))) & (near > np.arange(len(live))))
        if not len(mutual):  # sums that should be equal may round apart
            mutual = np.array([int(height.argmin())])
        pairs = np.sort(np.column_stack([mutual, near[mutual]]), axis=1)
        merges += [(float(height[a]), int(live[a]), int(live[b])) for a, b in pairs]
        rows = work.save(_contracted(rows, live, pairs), "sums")
        sizes[pairs[:, 0]] += sizes[pairs[:, 1]]
        stay = np.setdiff1d(np.arange(len(live)), pairs[:, 1])
        live, sizes = live[stay], sizes[stay]
    return merges


def _matrix(spark, points: np.ndarray, weights: np.ndarray, live: np.ndarray, starts: np.ndarray) -> DataFrame:
    """Rows of the sums of distances between clusters, whose points come one after the other from ``starts``."""
    # Clusters that are named by their first rows are larger the earlier they come.
    mixed = np.random.default_rng(0).permutation(len(live))
    shared = spark.sparkContext.broadcast((points, weights, live, starts, mixed))
    tasks = max(spark.sparkContext.defaultParallelism, len(live) ** 2 // 16_000_000, len(points) ** 2 // 1_000_000_000)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, weights, live, starts, mixed = shared.value
        ends = np.append(starts[1:], len(points))
        for batch in batches:
            own = mixed[batch.column(0).to_numpy()]
            for part in np.array_split(own, max(1, len(own) * len(live) // 1_000_000)):
                far = [_sums_between(points[a:b], weights[a:b], points, weights, starts) for a, b in zip(starts[part], ends[part], strict=True)]
                yield _rows(live[part], np.stack(far))

    return spark.range(0, len(live), 1, min(tasks, len(live))).mapInArrow(distances, _ROW)


def _nearest(rows: DataFrame, live: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every cluster, by its place in ``live``: the place of the nearest one, the first of equals, and its distance."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sums in _read(batch, len(live)):
                at = np.searchsorted(live, ids)
                mean = sums / (sizes[at][:, None] * sizes[None, :])
                mean[np.arange(len(at)), at] = np.inf
                best = mean.argmin(axis=1)
                columns = [pa.array(at), pa.array(best), pa.array(mean[np.arange(len(at)), best])]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "near", "height"])

    found = rows.mapInArrow(find, "at long, near long, height double").toPandas().sort_values("at")
    return found["at"].to_numpy(), found["near"].to_numpy(), found["height"].to_numpy()


def _contracted(rows: DataFrame, live: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """The matrix with both columns of each pair added up, then both rows; only rows of pairs are shuffled."""
    stay = np.setdiff1d(np.arange(len(live)), pairs[:, 1])
    target = np.arange(len(live))
    target[pairs[:, 1]] = pairs[:, 0]
    in_pair = np.zeros(len(live), bool)
    in_pair[pairs.ravel()] = True

    def columns(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sums in _read(batch, len(live)):
                at = np.searchsorted(live, ids)
                use = in_pair[at] == wanted
                if use.any():
                    at, sums = at[use], sums[use].copy()
                    sums[:, pairs[:, 0]] += sums[:, pairs[:, 1]]
                    yield _rows(live[target[at]], sums[:, stay])

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "sums": [np.stack(frame["sums"].to_numpy()).sum(axis=0)]})

    single = rows.mapInArrow(lambda batches: columns(batches, False), _ROW)
    double = rows.mapInArrow(lambda batches: columns(batches, True), _ROW).groupBy("id").applyInPandas(added, _ROW)
    return single.unionByName(double)


def _cut(n: int, merges: list[tuple[float, int, int]], groups: int) -> np.ndarray:
    """Group numbers after the ``n - groups`` lowest merges."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, kept, gone in sorted(merges, key=lambda m: m[0])[: max(n - groups, 0)]:
        parent[root(gone)] = root(kept)
    roots = np.array([root(i) for i in range(n)], dtype=np.int64)
    _, first, number = np.unique(roots, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number]
