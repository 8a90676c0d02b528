"""Connected components of the graph inside each object."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.operators.knn_graph import OBJECT, both_directions
from pointlake.operators.skew import HOT_ROWS, skew_join, stored_hot_keys
from pointlake.workspace import Workspace

# Edges of one object that a task may finish on its own, and edges aimed at per task.
MAX_OBJECT_EDGES = 2_000_000
_TASK_EDGES = 500_000


def smallest_reachable(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Task helper: the smallest node index in each node's component."""
    label = np.arange(n)
    while True:
        lower = np.minimum(label[src], label[dst])
        previous = label.copy()
        for side in (src, dst):
            np.minimum.at(label, previous[side], lower)
            np.minimum.at(label, side, lower)
        label = label[label]
        if np.array_equal(label, previous):
            return label


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    """Task helper: label every node of the whole objects in one bucket."""
    ends = pd.concat([frame[[*OBJECT, c]].set_axis([*OBJECT, "node"], axis=1) for c in ("src", "dst")])
    index = ends.groupby([*OBJECT, "node"], sort=True).ngroup().to_numpy()
    nodes = ends.assign(index=index).drop_duplicates("index").sort_values("index")
    label = smallest_reachable(len(nodes), index[: len(frame)], index[len(frame) :])
    ids = nodes["node"].to_numpy()
    return nodes[list(OBJECT)].assign(node=ids, root=ids[label])


def _contract(edges: DataFrame, seed: int, work: Workspace, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """One round: nodes join a neighbour that is a local minimum of a random order.

    Returns the edges between the merged nodes and the ``(node, root)`` moves. The
    order is a hash that changes every round, so a constant share of the nodes
    disappears in expectation even on long paths.
    """

    def order(column: str):
        return F.struct(F.xxhash64(F.col(column), F.lit(seed)).alias("h"), F.col(column).alias("node"))

    linked = both_directions(edges)
    # Reduced per task before the shuffle, so a node with very many edges is cheap.
    lowest = linked.groupBy(*OBJECT, "src").agg(
        F.min(order("dst")).alias("low"), F.count(F.lit(1)).alias("degree")
    )
    is_root = F.col("low") > order("src")
    parents = work.save(
        lowest.select(
            *OBJECT,
            F.col("src").alias("node"),
            F.when(is_root, F.col("src")).otherwise(F.col("low.node")).alias("root"),
            "degree",
        ),
        "parents",
    )
    roots = parents.filter("node = root").select(*OBJECT, F.col("node").alias("root"))
    moving = parents.filter("node <> root")
    crowded = stored_hot_keys(work, parents, [*OBJECT, "root"], hot_rows)
    joined = skew_join(moving, roots, [*OBJECT, "root"], hot=crowded)
    moves = work.save(joined.select(*OBJECT, "node", "root"), "moves")
    hubs = work.save(parents.filter(F.col("degree") > hot_rows).select(*OBJECT, "node"), "hubs")
    no_hubs = hubs.isEmpty()
    for end in ("src", "dst"):
        step = moves.select(*OBJECT, F.col("node").alias(end), F.col("root").alias("_to"))
        hot = False if no_hubs else hubs.withColumnRenamed("node", end)
        edges = skew_join(edges, step, [*OBJECT, end], "left", hot=hot)
        edges = edges.withColumn(end, F.coalesce("_to", end)).drop("_to")
    ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
    return work.save(edges.filter("src <> dst").withColumns(ends).distinct(), "edges"), moves


def connected_components(
    points: DataFrame,
    edges: DataFrame,
    work: Workspace | None = None,
    max_object_edges: int = MAX_OBJECT_EDGES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(shard, root_id, pid, component)``; a component is named by its smallest ``pid``.

    Objects whose edges fit ``max_object_edges`` are finished one bucket of objects per
    task. A larger object is first shrunk by contraction rounds, all such objects
    together, until it fits too; its edges roughly halve every round. Points without
    an edge are their own component.
    """
    work = work or Workspace(points.sparkSession)
    live = edges.select(*OBJECT, "src", "dst")
    small: list[DataFrame] = []
    rounds: list[DataFrame] = []
    total = 0
    while True:
        sizes = live.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("n"))
        counts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.max("n").alias("max")).first()
        if (counts["max"] or 0) <= max_object_edges:
            total += counts["all"]
            small.append(live)
            break
        # At most (all edges / max_object_edges) objects are large: a short list.
        large = work.save(sizes.filter(F.col("n") > max_object_edges).select(*OBJECT), "large")
        total += counts["all"]
        small.append(live.join(large, list(OBJECT), "left_anti"))
        live, moves = _contract(live.join(large, list(OBJECT), "left_semi"), len(rounds), work, hot_rows)
        rounds.append(moves)

    tasks = max(math.ceil(total / _TASK_EDGES), 1)
    bucket = F.pmod(F.xxhash64(*OBJECT), F.lit(tasks)).alias("bucket")
    finishing = reduce(DataFrame.unionByName, small).groupBy(bucket)
    labels = finishing.applyInPandas(_finish, "shard long, root_id long, node long, root long")
    if rounds:
        labels = _resolve(labels, rounds, work, hot_rows)
    named = labels.select(*OBJECT, F.col("node").alias("pid"), F.col("root").alias("component"))
    # One label per point on the right, and a point occurs once on the left: no hot key.
    joined = points.select(*OBJECT, "pid").join(named, [*OBJECT, "pid"], "left")
    return joined.withColumn("component", F.coalesce("component", "pid"))


def _resolve(labels: DataFrame, rounds: list[DataFrame], work: Workspace, hot_rows: int) -> DataFrame:
    """Follow the moves back from the last round, then rename roots to smallest members."""
    labels = work.save(labels, "labels")
    for moves in reversed(rounds):
        later = labels.select(*OBJECT, F.col("node").alias("root"), F.col("root").alias("_last"))
        hot = stored_hot_keys(work, moves, [*OBJECT, "root"], hot_rows)
        traced = skew_join(moves, later, [*OBJECT, "root"], "left", hot=hot)
        traced = traced.select(*OBJECT, "node", F.coalesce("_last", "root").alias("root"))
        labels = work.save(labels.unionByName(traced), "labels")
    # A root left without edges after the last round has no row of its own yet.
    selves = labels.select(*OBJECT, F.col("root").alias("node")).distinct()
    lone = selves.join(labels.select(*OBJECT, "node"), [*OBJECT, "node"], "left_anti")
    labels = work.save(labels.unionByName(lone.withColumn("root", F.col("node"))), "labels")
    smallest = labels.groupBy(*OBJECT, "root").agg(F.min("node").alias("_least"))
    hot = stored_hot_keys(work, labels, [*OBJECT, "root"], hot_rows)
    renamed = skew_join(labels, smallest, [*OBJECT, "root"], hot=hot)
    return renamed.select(*OBJECT, "node", F.col("_least").alias("root"))


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges with the component of their two ends."""
    ends = components.select(*OBJECT, F.col("pid").alias("src"), F.col("component").alias("component"))
    return skew_join(edges, ends, [*OBJECT, "src"])
