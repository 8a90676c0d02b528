"""Points to clusters: mean vectors, representative points and the mapping back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.columns import XYZ_COLUMNS as XYZ
from pointlake.functions.columns import distance
from pointlake.functions.vectors import mean_vector_by
from pointlake.operators.agglomerate import agglomerate
from pointlake.operators.knn_graph import OBJECT, knn_graph
from pointlake.operators.labels import contiguous_labels
from pointlake.operators.skew import HOT_ROWS, skew_join
from pointlake.workspace import Workspace

CLUSTER = (*OBJECT, "cluster")
LABELLED = (*OBJECT, "condensed_id")


def summarize(
    labelled: DataFrame, dims: int, work: Workspace | None = None, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(condensed, mapping)`` of stored points that carry a ``cluster``.

    ``condensed`` has one row per cluster: the mean ``embedding`` and the real point
    nearest the centroid, the smallest ``pid`` on ties. ``mapping`` has one row per
    point. ``condensed_id`` counts from 0 within each object.

    Means and centroids are one aggregation with partial sums. Only ids and coordinates
    are then shuffled once to give each point its label and its distance to the
    centroid; clusters of very many points are split.
    """
    work = work or Workspace(labelled.sparkSession)
    centres = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in XYZ]
    counted = F.count(F.lit(1)).alias("n_points")
    means = work.save(mean_vector_by(labelled, CLUSTER, "embedding", dims, counted, *centres), "means")
    ids = contiguous_labels(means, OBJECT, "cluster", "condensed_id")
    known = means.select(*CLUSTER, *[f"mean_{c}" for c in XYZ]).join(ids, list(CLUSTER))
    hot = work.save(means.filter(F.col("n_points") > hot_rows).select(*CLUSTER, F.col("n_points").alias("_n")), "hot")
    hot = False if hot.isEmpty() else hot
    placed = skew_join(labelled.select(*CLUSTER, "pid", *XYZ), known, CLUSTER, hot=hot)
    measured = placed.withColumn("distance", distance(XYZ, [f"mean_{c}" for c in XYZ]))
    placed = work.save(measured.select(*CLUSTER, "condensed_id", "pid", *XYZ, "distance"), "placed")
    best = F.min(F.struct("distance", "pid", *XYZ)).alias("_best")
    nearest = placed.groupBy(*CLUSTER, "condensed_id").agg(best)
    condensed = nearest.join(means.select(*CLUSTER, "embedding"), list(CLUSTER))
    condensed = condensed.select(*LABELLED, "embedding", *[F.col(f"_best.{c}").alias(c) for c in XYZ])
    return condensed, placed.select(*LABELLED, "pid", *XYZ)


def condense(
    points: DataFrame,
    threshold: float,
    dims: int,
    k: int = 3,
    work: Workspace | None = None,
    **clustering,
) -> tuple[DataFrame, DataFrame]:
    """``(condensed, mapping)`` of stored ``points`` with ``embedding`` of ``dims`` elements.

    The graph and the labelled points are stored as they are made, so each is computed
    once however many of the later steps read it. ``clustering`` goes to
    :func:`pointlake.operators.agglomerate.agglomerate`.
    """
    work = work or Workspace(points.sparkSession)
    edges = work.save(knn_graph(points, k, work), "graph")
    columns = points.select(*OBJECT, "pid", *XYZ, "embedding")
    labelled = work.save(agglomerate(columns, edges, threshold, work=work, **clustering), "labelled")
    return summarize(labelled, dims, work)
