"""Exact k-nearest-neighbour graph of the 3-D points inside each object."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.bits import interleave
from pointlake.functions.columns import XYZ_COLUMNS
from pointlake.operators.labels import ID_LEVELS, id_bucket, numbered
from pointlake.operators.skew import HOT_ROWS, skew_join, stored_hot_keys
from pointlake.workspace import Workspace

OBJECT = ("shard", "root_id")
XYZ = XYZ_COLUMNS
_CURVE_BITS = 20
_BROADCAST_ROWS = 100_000
# Grid level of points whose radius is not known: fewer than k points of their object
# came near them in curve order. An object has at most 2 k of them, all if it is that small.
_ALONE = -5000


def _with_curve(points: DataFrame, work: Workspace, hot: DataFrame | bool) -> DataFrame:
    """Add ``curve``, the place of a point along a space-filling curve of its object.

    The steps are finest about the middle of each object and never end, so neither
    another object nor a few far points of its own coarsen the curve where most are.
    """
    steps = 2**_CURVE_BITS - 1
    spread = [F.percentile_approx(c, [0.1, 0.5, 0.9], 200).alias(f"_q{c}") for c in XYZ]
    middles = work.save(points.groupBy(*OBJECT).agg(*spread), "middles")
    known = skew_join(points, middles, OBJECT, hot=hot)
    cells = {}
    for name in XYZ:
        q = F.col(f"_q{name}")
        wide = F.when(q[2] > q[0], q[2] - q[0]).otherwise(F.lit(1.0))
        away = (F.col(name) - q[1]) / wide
        share = F.lit(0.5) + F.lit(0.5) * away / (F.lit(1.0) + F.abs(away))
        cells[f"_{name}"] = F.floor(share * steps)
    return known.withColumns(cells).withColumn("curve", interleave(list(cells), _CURVE_BITS)).drop(
        *cells, *[f"_q{c}" for c in XYZ]
    )


def _search_radii(k: int, lowest_level: int):
    """Task helper: an upper bound on each point's k-th neighbour distance.

    Rows arrive in curve order, so the rows around a point are mostly near it. Any k
    points of the object bound the distance. Rows at the end of a batch wait for the
    next one, so only the ends of a partition have fewer rows around them.
    """
    reach = max(k, 8)

    def sized(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        xyz = frame[list(XYZ)].to_numpy("float64")
        owner = frame.groupby(list(OBJECT), sort=False).ngroup().to_numpy()
        squares = []
        for step in range(1, min(reach, n - 1) + 1):
            gap = ((xyz[step:] - xyz[:-step]) ** 2).sum(axis=1)
            gap[owner[step:] != owner[:-step]] = np.inf
            pad = np.full(step, np.inf)
            squares += [np.concatenate([gap, pad]), np.concatenate([pad, gap])]
        if len(squares) >= k:
            radius = np.sqrt(np.partition(np.stack(squares), k - 1, axis=0)[k - 1]) * (1 + 1e-9)
        else:
            radius = np.full(n, np.inf)
        level = np.full(n, lowest_level, dtype="int64")
        known = np.isfinite(radius) & (radius > 0)
        level[known] = np.maximum(lowest_level, 2 * np.ceil(np.log2(2 * radius[known]) / 2).astype("int64"))
        level[np.isinf(radius)] = _ALONE
        return frame.assign(radius=radius, level=level)

    def radii(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = None, 0  # rows kept back, the first ``done`` of them given out already
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            ready = len(held) - reach
            if ready > done:
                yield sized(held).iloc[done:ready]
                first = max(0, ready - reach)
                held, done = held.iloc[first:], ready - first
        if held is not None and len(held) > done:
            yield sized(held).iloc[done:]

    return radii


def _cell(coordinate, level):
    return F.floor(coordinate / F.pow(F.lit(2.0), level)).cast("long")


def nearest_neighbours(
    points: DataFrame, k: int = 3, work: Workspace | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(shard, root_id, pid, neighbour)``: the ``min(k, n - 1)`` nearest other points.

    Ties go to the smaller ``pid``; a point with more than ``k`` copies of its location
    takes the next ``k`` of them. The result equals a brute-force search:

    1. Points with more than ``k`` copies are linked along the id order of the copies.
       For all others, only the ``k + 1`` smallest ids of a location need be looked at.
    2. These points are range-partitioned along a space-filling curve, which
       splits an object of any size, and get an upper bound r on their search radius.
    3. A point without such a bound, one of a few per object, is compared with all of its object.
       Every other point looks up the at most eight cells of side >= 2r that its search ball
       touches and keeps the k nearest. Cells follow the local density, so a point is
       compared with a number of others that does not grow with the object.

    ``points`` is scanned a few times; pass a stored table rather than a long lineage.
    """
    work = work or Workspace(points.sparkSession)
    pts = points.select(*OBJECT, "pid", *[F.col(c).cast("double").alias(c) for c in XYZ])

    bounds = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("low", F.min), ("high", F.max))]
    bad = F.count_if(F.greatest(*[F.coalesce(F.abs(c), F.lit(math.nan)) for c in XYZ]) > 1e300)
    row = pts.agg(*bounds, bad.alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} points have a missing or non-finite coordinate")
    low = [row[f"low_{c}"] or 0.0 for c in XYZ]
    high = [row[f"high_{c}"] or 0.0 for c in XYZ]
    largest = max(1e-300, *map(abs, low), *map(abs, high))
    lowest_level = math.ceil(math.log2(largest)) - 60

    place = [*OBJECT, *XYZ]
    copies = Window.partitionBy(*place).orderBy("pid")
    kept = pts.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    along = [*OBJECT, "curve", "pid"]
    kept = work.save(kept, "kept")
    hot = stored_hot_keys(work, kept, OBJECT, hot_rows)
    ordered = _with_curve(kept, work, hot).repartitionByRange(*along)
    schema = "shard long, root_id long, pid long, x double, y double, z double, copy int, radius double, level long"
    typed = ordered.sortWithinPartitions(*along).select(
        *[F.col(c).cast("long").alias(c) for c in (*OBJECT, "pid")], *XYZ, "copy"
    )
    searched = work.save(typed.mapInPandas(_search_radii(k, lowest_level), schema), "search")

    lows = {c: F.col(c) - F.col("radius") for c in XYZ}
    highs = {c: F.col(c) + F.col("radius") for c in XYZ}
    crowded = searched.filter(F.col("copy") == k + 1).select(*place)
    n_crowded = crowded.count()
    queries = searched.select(*OBJECT, "pid", *XYZ, "radius", "level")
    if n_crowded:
        known = F.broadcast(crowded) if n_crowded <= _BROADCAST_ROWS else crowded
        queries = queries.join(known, place, "left_anti")
    alone = queries.filter(F.col("level") == _ALONE).select(*OBJECT, "pid", *XYZ)
    queries = queries.filter(F.col("level") != _ALONE)
    for c in XYZ:
        span = F.sequence(_cell(lows[c], F.col("level")), _cell(highs[c], F.col("level")))
        queries = queries.withColumn(f"c{c}", F.explode(span))
    levels = searched.filter(F.col("level") != _ALONE).select(*OBJECT, "level").distinct()
    candidates = skew_join(searched.select(*OBJECT, "pid", *XYZ), levels, OBJECT, hot=hot)
    candidates = candidates.select(
        *OBJECT,
        F.col("pid").alias("neighbour"),
        *[F.col(c).alias(f"n{c}") for c in XYZ],
        "level",
        *[_cell(F.col(c), F.col("level")).alias(f"c{c}") for c in XYZ],
    )
    pairs = candidates.join(queries, [*OBJECT, "level", "cx", "cy", "cz"]).filter("pid <> neighbour")
    square = sum(((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) for c in XYZ), F.lit(0.0))
    close = pairs.withColumn("square", square).filter(F.col("square") <= F.col("radius") * F.col("radius"))
    mates = searched.select(*OBJECT, F.col("pid").alias("neighbour"), *[F.col(c).alias(f"n{c}") for c in XYZ])
    every = skew_join(mates, alone, OBJECT, hot=hot).filter("pid <> neighbour").withColumn("square", square)
    found = [*OBJECT, "pid", "neighbour", "square"]
    ranked = Window.partitionBy(*OBJECT, "pid").orderBy("square", "neighbour")
    near = close.select(*found).unionByName(every.select(*found))
    near = near.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
    result = near.select(*OBJECT, "pid", "neighbour")

    if n_crowded == 0:
        return result
    return result.unionByName(_among_copies(pts, crowded, n_crowded, k, work, hot_rows))


def _among_copies(
    pts: DataFrame, crowded: DataFrame, n_crowded: int, k: int, work: Workspace, hot_rows: int
) -> DataFrame:
    """Neighbours of points with more than ``k`` copies of their location.

    All copies are equally near, so each takes the next ``k`` in id order, around the
    end. No copy gets more than ``2 k`` links this way, however many there are.
    """
    place = [*OBJECT, *XYZ]
    if n_crowded <= _BROADCAST_ROWS:
        copies = pts.join(F.broadcast(crowded), place)
    else:
        copies = skew_join(pts, crowded, place, hot_rows=hot_rows)
    ranked = work.save(numbered(copies, place, id_bucket("pid"), ["pid"], "rank", ID_LEVELS), "copies")
    sizes = ranked.groupBy(*place).agg(F.count(F.lit(1)).alias("size"))
    hot = work.save(sizes.filter(F.col("size") > hot_rows).select(*place, F.col("size").alias("_n")), "hot")
    sized = skew_join(ranked, sizes, place, hot=False if hot.isEmpty() else hot)
    steps = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")
    wanted = sized.select(*place, "pid", "rank", "size", steps)
    wanted = wanted.select(*place, "pid", F.pmod(F.col("rank") + F.col("step"), F.col("size")).alias("rank"))
    found = wanted.join(ranked.withColumnRenamed("pid", "neighbour"), [*place, "rank"])
    return found.select(*OBJECT, "pid", "neighbour")


def undirected(neighbours: DataFrame) -> DataFrame:
    """``(shard, root_id, src, dst)`` with ``src < dst``, one row per linked pair."""
    ends = (F.least("pid", "neighbour").alias("src"), F.greatest("pid", "neighbour").alias("dst"))
    return neighbours.select(*OBJECT, *ends).distinct()


def knn_graph(points: DataFrame, k: int = 3, work: Workspace | None = None) -> DataFrame:
    """Undirected edges of the symmetrised k-nearest-neighbour graph.

    Objects of at most ``k + 1`` points come out as complete graphs.
    """
    return undirected(nearest_neighbours(points, k, work))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two directed rows."""
    reverse = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(reverse)
