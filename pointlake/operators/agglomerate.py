"""Clustering of each component along its edges, cut at a distance threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.operators.components import component_edges, connected_components
from pointlake.operators.knn_graph import OBJECT, both_directions
from pointlake.operators.skew import HOT_ROWS, skew_join, stored_hot_keys
from pointlake.workspace import Workspace

COMPONENT = (*OBJECT, "component")
POINT = (*OBJECT, "pid")
# Points clustered together in one task at most, and points aimed at per task.
MAX_TASK_POINTS = 50_000
_TASK_POINTS = 50_000
# The proposals' order in a round; SQL can compute it too.
_PRIME = 1_000_003
_FACTORS = (7919, 104_729, 15_485_863)


# --- task helpers: the same definition on the arrays of one task ---------------------


def _square_sum(values: np.ndarray) -> np.ndarray:
    """Sum of squares per row, dimension after dimension as the joins add them."""
    total = np.zeros(len(values))
    for column in values.T:
        total += column * column
    return total


def _pair_distance(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = [np.sqrt(_square_sum(m))[:, None] for m in (left, right)]
        left, right = (m / np.where(n == 0, 1, n) for m, n in zip((left, right), norms, strict=True))
        return 0.5 * _square_sum(left - right)
    return np.sqrt(_square_sum(left - right))


def _ward(n_a, mean_a, n_b, mean_b):
    return np.sqrt(2.0 * n_a * n_b / (n_a + n_b) * _square_sum(mean_a - mean_b))


def _matched(src, dst, weight, pid, turn, mutual):
    """Pairs of clusters that merge in a round: see :func:`agglomerate`."""
    n = len(pid)
    ends, others = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.lexsort((others, np.tile(weight, 2), ends))
    asks, first = np.unique(ends[order], return_index=True)
    asked = others[order][first]
    pairs, votes = np.unique(np.sort(np.column_stack([asks, asked]), axis=1), axis=0, return_counts=True)
    if mutual:
        return pairs[votes == 2].T
    keep, gone = pairs.T
    order = np.lexsort((gone, keep, np.where(votes == 2, 0, 1 + _turn_order(pid[keep], pid[gone], turn))))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    best = np.full(n, len(order))
    for end in (keep, gone):
        np.minimum.at(best, end, place)
    chosen = (best[keep] == place) & (best[gone] == place)
    return keep[chosen], gone[chosen]


def _turn_order(keep, gone, turn):
    """A number that orders proposals anew each round; plain arithmetic, so it is the same everywhere."""
    mixed = keep % _PRIME * _FACTORS[0] + gone % _PRIME * _FACTORS[1] + turn * _FACTORS[2]
    return mixed % _PRIME


def _rounds(src, dst, vectors, pid, threshold, linkage, metric, mutual=False):
    """Rounds of merges until no linked pair is closer than the threshold; returns owners and rounds."""
    n = len(vectors)
    owner, count, means = np.arange(n), np.ones(n), vectors
    weight = _pair_distance(vectors[src], vectors[dst], metric)
    turn = 0
    while len(src):
        if linkage == "ward":
            weight = _ward(count[src], means[src], count[dst], means[dst])
        below = weight < threshold
        if not below.any():
            break
        keep, gone = _matched(src[below], dst[below], weight[below], pid, turn, mutual)
        total = count[keep] + count[gone]
        means = means.copy()
        means[keep] = (means[keep] * count[keep, None] + means[gone] * count[gone, None]) / total[:, None]
        count[keep] = total
        step = np.arange(n)
        step[gone] = keep
        owner = step[owner]
        frame = pd.DataFrame({"a": step[src], "b": step[dst], "w": weight})
        frame[["a", "b"]] = np.sort(frame[["a", "b"]].to_numpy(), axis=1)
        frame = frame[frame["a"] != frame["b"]].groupby(["a", "b"], sort=False)["w"].max().reset_index()
        src, dst, weight = (frame[c].to_numpy() for c in "abw")
        turn += 1
    return owner, turn


def _labeller(threshold: float, linkage: str, metric: str, mutual: bool):
    """Task helper: name the cluster of every point of the objects in one bucket."""

    def label(points: pa.Table, edges: pa.Table) -> pa.Table:
        points = points.drop_columns(["bucket"]).sort_by([(c, "ascending") for c in POINT])
        n = points.num_rows
        index = pd.MultiIndex.from_arrays([points[c].to_numpy() for c in POINT])
        objects = [edges[c].to_numpy() for c in OBJECT]
        src, dst = (
            index.get_indexer(pd.MultiIndex.from_arrays([*objects, edges[c].to_numpy()])) for c in ("src", "dst")
        )
        flat = pa.concat_arrays(points["embedding"].chunks).flatten() if n else pa.array([], pa.float32())
        vectors = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1 if n else 0)
        pid = points["pid"].to_numpy()
        owner, _ = _rounds(src, dst, vectors, pid, threshold, linkage, metric, mutual)
        return points.append_column("cluster", pa.array(pid[owner], pa.int64()))

    return label


def _labelled_in_tasks(points: DataFrame, edges: DataFrame, keys: tuple[str, ...], total: int, labeller) -> DataFrame:
    """Cluster whole ``keys`` groups, many per task: one shuffle of points and edges."""
    tasks = max(math.ceil(total / _TASK_POINTS), points.sparkSession.sparkContext.defaultParallelism)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(tasks))
    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.LongType())])
    left, right = (df.withColumn("bucket", bucket).groupBy("bucket") for df in (points, edges))
    return left.cogroup(right).applyInArrow(labeller, schema)


# --- joins over all large components at once ------------------------------------------


def _sql_ward(n_a: str, a: str, n_b: str, b: str):
    square = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x
    )
    return F.sqrt(F.lit(2.0) * F.col(n_a) * F.col(n_b) / (F.col(n_a) + F.col(n_b)) * square)


def _sql_pair(a: str, b: str, metric: str):
    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
        return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))

    left, right = (unit(c) if metric == "cosine" else F.col(c) for c in (a, b))
    square = F.aggregate(
        F.zip_with(left, right, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x
    )
    return F.lit(0.5) * square if metric == "cosine" else F.sqrt(square)


def _attach(edges: DataFrame, clusters: DataFrame, hot: dict[str, DataFrame | bool]) -> DataFrame:
    """Add the size and mean of the clusters at both ends of each edge."""
    for end in ("src", "dst"):
        side = clusters.select(
            *OBJECT, F.col("cluster").alias(end), F.col("n").alias(f"n_{end}"), F.col("mean").alias(f"mean_{end}")
        )
        edges = skew_join(edges, side, [*OBJECT, end], hot=hot[end])
    return edges


def _hubs(work: Workspace, edges: DataFrame, hot_rows: int) -> dict[str, DataFrame | bool]:
    return {end: stored_hot_keys(work, edges, [*OBJECT, end], hot_rows) for end in ("src", "dst")}


def _distributed_rounds(
    points: DataFrame,
    edges: DataFrame,
    threshold: float,
    linkage: str,
    metric: str,
    work: Workspace,
    hot_rows: int,
    mutual: bool,
) -> DataFrame:
    """The merge rounds as joins; the number of jobs does not grow with the number of objects."""
    ward = linkage == "ward"
    mean = F.col("embedding").cast("array<double>").alias("mean")
    clusters = work.save(points.select(*OBJECT, F.col("pid").alias("cluster"), F.lit(1.0).alias("n"), mean), "clusters")
    # Only ids go through the rounds; the vectors join again at the end.
    members = work.save(points.select(*POINT, F.col("pid").alias("cluster")), "members")
    weight = _sql_ward("n_src", "mean_src", "n_dst", "mean_dst") if ward else _sql_pair("mean_src", "mean_dst", metric)
    live = work.save(edges.select(*OBJECT, "src", "dst"), "linked")
    live = _attach(live, clusters, _hubs(work, live, hot_rows))
    live = work.save(live.select(*OBJECT, "src", "dst", weight.alias("weight")), "weighted")
    turn = 0
    while True:
        near = both_directions(live.filter(F.col("weight") < threshold))
        merges = work.save(_sql_matched(near, turn, mutual), "merges")
        if merges.isEmpty():
            # A cluster id occurs once per point, and a point once on either side.
            return points.join(members, list(POINT))
        turn += 1
        step = merges.select(*OBJECT, F.col("gone").alias("cluster"), F.col("keep").alias("_to"))
        hot = stored_hot_keys(work, members, [*OBJECT, "cluster"], hot_rows)
        moved = skew_join(members, step, [*OBJECT, "cluster"], "left", hot=hot)
        members = work.save(moved.select(*POINT, F.coalesce("_to", "cluster").alias("cluster")), "members")
        hubs = _hubs(work, live, hot_rows)
        stay = merges.select(*OBJECT, F.col("keep").alias("cluster"), F.lit(None).cast("long").alias("_to"))
        touched = step.unionByName(stay).withColumn("_hit", F.lit(True))
        for end in ("src", "dst"):
            live = skew_join(live, touched.withColumnsRenamed({"cluster": end}), [*OBJECT, end], "left", hot=hubs[end])
            live = live.withColumns({end: F.coalesce("_to", end), f"hit_{end}": F.coalesce("_hit", F.lit(False))})
            live = live.drop("_to", "_hit")
        ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
        live = live.filter("src <> dst").withColumns({**ends, "hit": F.col("hit_src") | F.col("hit_dst")})
        live = live.groupBy(*OBJECT, "src", "dst").agg(F.max("weight").alias("weight"), F.max("hit").alias("hit"))
        if ward:
            clusters = work.save(_merge_clusters(clusters, merges), "clusters")
            live = work.save(live, "contracted")
            changed = live.filter("hit").select(*OBJECT, "src", "dst")
            fresh = _attach(changed, clusters, _hubs(work, live, hot_rows))
            fresh = fresh.select(*OBJECT, "src", "dst", weight.alias("weight"))
            live = live.filter("not hit").drop("hit").unionByName(fresh)
        else:
            live = live.drop("hit")
        live = work.save(live, "weighted")


def _sql_matched(near: DataFrame, turn: int, mutual: bool) -> DataFrame:
    """:func:`_matched` over links in both directions; each node picks one proposal, both ends must agree."""
    best = near.groupBy(*OBJECT, "src").agg(F.min(F.struct("weight", "dst")).alias("best"))
    asked = best.select(*OBJECT, F.least("src", "best.dst").alias("keep"), F.greatest("src", "best.dst").alias("gone"))
    proposals = asked.groupBy(*OBJECT, "keep", "gone").agg(F.count(F.lit(1)).alias("votes"))
    if mutual:
        return proposals.filter("votes = 2").drop("votes")
    keep, gone = (F.pmod(c, F.lit(_PRIME)) for c in ("keep", "gone"))
    mixed = keep * F.lit(_FACTORS[0]) + gone * F.lit(_FACTORS[1]) + F.lit(turn * _FACTORS[2])
    order = F.when(F.col("votes") == 2, F.lit(0)).otherwise(F.pmod(mixed, F.lit(_PRIME)) + 1).cast("long")
    ranked = proposals.select(*OBJECT, F.struct(order.alias("order"), "keep", "gone").alias("rank"))
    ends = ranked.select(*OBJECT, F.explode(F.array("rank.keep", "rank.gone")).alias("node"), "rank")
    picks = ends.groupBy(*OBJECT, "node").agg(F.min("rank").alias("rank"))
    agreed = picks.groupBy(*OBJECT, "rank.keep", "rank.gone").agg(F.count(F.lit(1)).alias("picks"))
    return agreed.filter("picks = 2").drop("picks")


def _merge_clusters(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Replace both clusters of each merge by their union; a cluster is in at most one."""
    gone = clusters.select(*OBJECT, F.col("cluster").alias("gone"), F.col("n").alias("n_b"), F.col("mean").alias("b"))
    partner = merges.join(gone, [*OBJECT, "gone"]).withColumnRenamed("keep", "cluster").drop("gone")
    lost = merges.select(*OBJECT, F.col("gone").alias("cluster"))
    left = clusters.withColumnsRenamed({"n": "n_a", "mean": "a"})
    left = left.join(lost, [*OBJECT, "cluster"], "left_anti").join(partner, [*OBJECT, "cluster"], "left")
    total = F.col("n_a") + F.col("n_b")
    merged = F.zip_with("a", "b", lambda x, y: (x * F.col("n_a") + y * F.col("n_b")) / total)
    return left.select(*OBJECT, "cluster", F.coalesce(total, "n_a").alias("n"), F.coalesce(merged, "a").alias("mean"))


def agglomerate(
    points: DataFrame,
    edges: DataFrame,
    threshold: float,
    linkage: str = "ward",
    metric: str = "euclidean",
    max_task_points: int = MAX_TASK_POINTS,
    work: Workspace | None = None,
    hot_rows: int = HOT_ROWS,
    merges: str = "proposals",
) -> DataFrame:
    """``points`` with the ``cluster`` of each; a cluster is named by its smallest ``pid``.

    Only linked clusters merge. ``linkage`` is ``ward`` (increase in variance) or
    ``complete`` (largest link between the two). In a round every cluster with a link
    shorter than ``threshold`` proposes to merge with the nearest of them, the smaller id
    on ties. Of the proposals that meet in a cluster one is picked: one that both sides
    made, or else the first in an order that changes each round. A proposal that both its
    ends pick merges. Rounds go on until there is no proposal.

    Mutual proposals always merge, as closest pairs do when taken one at a time; the
    others keep the number of rounds logarithmic even where distances shrink along a
    path. With ``merges="mutual"`` only mutual proposals merge: that is nearly the order of
    one closest pair at a time, but a path of ever shorter links takes a round for each
    link, which matters where the rounds are joins. The result does not depend on how the work is divided: a point set of any size
    is clustered by the same definition and the same order of additions.

    Objects of up to ``max_task_points`` are clustered whole, many per task, with one
    shuffle of the vectors. A larger object is taken apart into its components, which
    are independent; a component that is still larger runs the rounds as joins over
    all such components at once.
    """
    if linkage not in ("ward", "complete"):
        raise ValueError(f"unsupported linkage {linkage!r}")
    if linkage == "ward" and metric != "euclidean":
        raise ValueError("ward linkage needs the euclidean metric")
    if merges not in ("proposals", "mutual"):
        raise ValueError(f"unknown merges {merges!r}")
    work, mutual = work or Workspace(points.sparkSession), merges == "mutual"
    labeller = _labeller(threshold, linkage, metric, mutual)

    objects = points.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("n"))
    total, largest = _total_and_largest(objects)
    if largest <= max_task_points:
        return _labelled_in_tasks(points, edges, OBJECT, total, labeller)

    # The lists of large groups are stored, so the optimizer broadcasts them if they are short.
    large = work.save(objects.filter(F.col("n") > max_task_points).select(*OBJECT), "large-objects")
    whole = [df.join(large, list(OBJECT), "left_anti") for df in (points, edges)]
    labelled = _labelled_in_tasks(*whole, OBJECT, total, labeller)

    points, edges = (df.join(large, list(OBJECT), "left_semi") for df in (points, edges))
    components = work.save(connected_components(points, edges, work, hot_rows=hot_rows), "components")
    sizes = components.groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("n"))
    total, largest = _total_and_largest(sizes)
    columns = points.columns
    points = points.join(components, list(POINT))
    edges = component_edges(edges, components)
    big = work.save(sizes.filter(F.col("n") > max_task_points).select(*COMPONENT), "large-components")
    small = [df.join(big, list(COMPONENT), "left_anti") for df in (points, edges)]
    labelled = labelled.unionByName(
        _labelled_in_tasks(*small, COMPONENT, total, labeller).select(*columns, "cluster")
    )
    if largest <= max_task_points:
        return labelled
    points, edges = (df.join(big, list(COMPONENT), "left_semi") for df in (points, edges))
    points = work.save(points.select(*columns), "large-points")
    members = _distributed_rounds(points, edges, threshold, linkage, metric, work, hot_rows, mutual)
    return labelled.unionByName(members)


def _total_and_largest(sizes: DataFrame) -> tuple[int, int]:
    return tuple(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())
