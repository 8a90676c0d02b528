"""Upkeep of a vector index that has been appended to: cells are split and merged where they need it."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.operators.search import VectorIndex, lloyd, train_books
from pointlake.sinks.partitioned import write_partitioned

# A cell is split above this many times the mean number of rows, or, if it has at least half
# of that mean, above this many times the usual distance of rows from their centre. It is
# merged with its nearest one below this part of the mean.
CROWDED = 2.0
WIDE = 2.0
SPARSE = 1 / 16
# Cells that one cell is split into, at most.
_MOST = 64


def regrouped_cells(
    index: VectorIndex, counts: np.ndarray, far: np.ndarray, crowded: float = CROWDED, wide: float = WIDE, sparse: float = SPARSE
) -> list[tuple[list[int], int]]:
    """``(cells to retire, number of cells in their place)``, from rows and mean distance of each cell."""
    live = np.flatnonzero(index.live)
    if not counts[live].sum():
        return []
    mean, typical = counts[live].mean(), np.median(far[live][counts[live] > 0])
    split = {c for c in live if counts[c] > crowded * mean or counts[c] > mean / 2 and far[c] > wide * typical}
    groups: dict[int, list[int]] = {}
    stay = [c for c in live if c not in split and counts[c] >= sparse * mean]
    for cell in live:
        if cell not in split and counts[cell] < sparse * mean and stay:
            gap = ((index.centres[stay] - index.centres[cell]) ** 2).sum(axis=1)
            groups.setdefault(int(stay[int(gap.argmin())]), []).append(int(cell))
    merges = [([partner, *cells], 1) for partner, cells in sorted(groups.items())]
    parts = [([int(c)], int(np.clip(math.ceil(counts[c] / mean), 2, _MOST))) for c in sorted(split)]
    return merges + parts


def maintain(
    spark: SparkSession, index: VectorIndex, training_rows: int = 65_536,
    crowded: float = CROWDED, wide: float = WIDE, sparse: float = SPARSE,
) -> VectorIndex:
    """The index with crowded and wide cells split and sparse ones merged; an index that is in order comes back as it is.

    Only the rows of those cells are written anew, into new cells; files of all others stay
    as they are. The new cells' centres, and a code book of their own for them, are
    trained on at most ``training_rows`` of the rows, chosen by a hash of the id and
    shared out among the regrouped cells; every row is then assigned and encoded.

    The rows are in place before the stored model names the new cells, and the old ones are
    deleted after that. A run that ends half-way leaves an index that answers as before or
    as after it, and can be repeated.
    """
    facts = index.rows(spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("far").alias("far")).collect()
    counts, far = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    for r in facts:
        counts[r["cell"]], far[r["cell"]] = r["n"], r["far"]
    groups = regrouped_cells(index, counts, far, crowded, wide, sparse)
    if not groups:
        return index
    retired = sorted(c for cells, _ in groups for c in cells)
    rows = spark.read.parquet(index.path).filter(F.col("cell").isin(retired))
    group_of = {c: g for g, (cells, _) in enumerate(groups) for c in cells}
    sample = _sample(rows, index, group_of, max(256, training_rows // len(groups))).persist()
    wanted = [n for _, n in groups]

    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order", kind="stable")
        vectors = np.stack(frame["_vector"].to_numpy()).astype("float64")
        start = np.unique(vectors, axis=0, return_index=True)[1]
        centres = lloyd(vectors, vectors[np.sort(start)[: wanted[int(key[0])]]].copy(), 20)
        return pd.DataFrame({"group": [key[0]] * len(centres), "centre": list(centres)})

    trained = sample.groupBy("group").applyInPandas(train, "group int, centre array<double>").collect()
    centres = np.array([r["centre"] for r in sorted(trained, key=lambda r: (r["group"], r["centre"]))])
    parts, codes, width = index.books[0].shape
    books = train_books(sample.select("order", "_vector"), parts, codes, width)
    sample.unpersist()

    live = index.live.copy()
    live[retired] = False
    fresh = np.ones(len(centres), bool)
    changed = replace(
        index,
        centres=np.concatenate([index.centres, centres]),
        books=[*index.books, books],
        live=np.concatenate([live, fresh]),
        generation=np.concatenate([index.generation, np.full(len(centres), len(index.books))]),
    )
    allowed = np.concatenate([np.zeros(len(live), bool), fresh])
    moved = changed.coded(rows.drop("cell", "codes", "far"), allowed)
    write_partitioned(moved, index.path, ["cell"], replace="partitions")
    changed.save(spark)
    _delete_cells(spark, index.path, retired)
    return changed


def _sample(rows: DataFrame, index: VectorIndex, group_of: dict[int, int], most: int) -> DataFrame:
    """``(group, order, _vector)``: at most ``most`` rows of each group, the first by a hash of the id."""
    pairs = [F.lit(x) for pair in group_of.items() for x in pair]
    order = F.xxhash64(*index.pid).alias("order")
    keyed = rows.select(F.create_map(*pairs)[F.col("cell")].alias("group"), order, F.col(index.vector).alias("_vector"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("order"))
    return keyed.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _delete_cells(spark: SparkSession, path: str, cells: list[int]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for cell in cells:
        folder = hadoop.Path(f"{path}/cell={cell}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
