"""Nearest rows to a query vector: exact, and through an inverted-file index with codes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.vectors import squared_l2
from pointlake.sinks.partitioned import write_partitioned

_TRAINING_ROWS_PER_TASK = 4096


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, pid: Sequence[str]) -> DataFrame:
    """The ``k`` rows nearest ``query`` with ``distance``; ties go to the smaller id.

    Distances are generated code and each task keeps only its own best ``k`` rows.
    """
    square = squared_l2(vector, query)
    best = df.withColumn("distance", square).orderBy("distance", *pid).limit(k)
    return best.withColumn("distance", F.sqrt("distance"))


@dataclass
class VectorIndex:
    """Where an index is stored, its cell centres and its code books.

    Centres are ``cells x dims`` numbers and a code book ``parts x codes x dims / parts``:
    sizes set by the parameters, not by the data. Upkeep retires cells and adds others;
    ``live`` tells them apart, and ``generation`` which code book a cell's rows use.
    """

    path: str
    vector: str
    pid: list[str]
    centres: np.ndarray
    books: list[np.ndarray]
    live: np.ndarray
    generation: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """The stored rows of the live cells."""
        if self.live.all():
            return spark.read.parquet(self.path)
        return spark.read.parquet(self.path).filter(F.col("cell").isin(np.flatnonzero(self.live).tolist()))

    def to_centres(self, matrix: np.ndarray) -> np.ndarray:
        """Distances of vectors (rows) to centres (columns), by differences, so that bounds lose no digits."""
        far = np.stack([np.sqrt(((self.centres - query) ** 2).sum(axis=1)) for query in matrix])
        far[:, ~self.live] = np.inf
        return far

    def search(
        self, spark: SparkSession, query: Sequence[float], k: int, nprobe: int = 16, refine: int = 10
    ) -> DataFrame:
        """Approximate ``k`` nearest rows.

        Only the ``nprobe`` cells nearest the query are read. Their rows are ranked on
        codes alone, so the scan is a few bytes per row; the best ``k * refine`` are
        ranked again on the vectors themselves. More of either is closer to exact.
        """
        target = np.asarray(query, dtype="float64")
        order = np.argsort(self.to_centres(target[None])[0], kind="stable")[: min(nprobe, int(self.live.sum()))]
        probed = spark.read.parquet(self.path).filter(F.col("cell").isin([int(c) for c in order]))
        tables = [code_table(book, target) for book in self.books]
        generation = self.generation

        def estimate(cells: pd.Series, codes: pd.Series) -> pd.Series:
            matrix, of = np.stack(codes.to_numpy()).astype("int64"), generation[cells.to_numpy()]
            total = np.empty(len(matrix))
            for g in np.unique(of):
                total[of == g] = tables[g][np.arange(matrix.shape[1]), matrix[of == g]].sum(axis=1)
            return pd.Series(total)

        rough = probed.select(*self.pid, F.pandas_udf(estimate, "double")("cell", "codes").alias("_rough"))
        short = rough.orderBy("_rough", *self.pid).limit(k * refine).drop("_rough")
        chosen = probed.drop("codes", "cell", "far").join(short, self.pid)
        return nearest(chosen, self.vector, query, k, self.pid)

    def coded(self, df: DataFrame, allowed: np.ndarray | None = None) -> DataFrame:
        """``df`` with the ``cell`` and ``codes`` of each vector, and how ``far`` it is from the centre."""
        cells = np.flatnonzero(self.live if allowed is None else allowed)
        centres, generation, encode = self.centres[cells], self.generation, [_encoder(b) for b in self.books]

        def place(vectors: pd.Series) -> pd.DataFrame:
            matrix = np.stack(vectors.to_numpy()).astype("float64")
            nearest_one = ((centres**2).sum(1) - 2 * matrix @ centres.T).argmin(axis=1)
            cell = cells[nearest_one]
            codes = np.empty(len(cell), dtype=object)
            for g in np.unique(generation[cell]):
                at = np.flatnonzero(generation[cell] == g)
                codes[at] = list(encode[g](matrix[at]))
            far = np.sqrt(((matrix - centres[nearest_one]) ** 2).sum(axis=1))
            return pd.DataFrame({"cell": cell, "codes": codes, "far": far})

        kind = "cell int, codes array<smallint>, far double"
        placed = df.select(*df.columns, F.pandas_udf(place, kind)(self.vector).alias("_place"))
        return placed.select(*df.columns, "_place.*")

    def append(self, df: DataFrame) -> None:
        """Add rows to the stored ones; centres and code books stay as they are, see ``maintain``."""
        write_partitioned(self.coded(df), self.path, ["cell"], mode="append")

    def save(self, spark: SparkSession) -> None:
        """Store the small arrays beside the rows."""
        arrays = {n: getattr(self, n).tolist() for n in ("centres", "live", "generation")}
        books = [b.tolist() for b in self.books]
        text = json.dumps({"vector": self.vector, "pid": self.pid, "books": books, **arrays})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.path + "-model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        stored = json.loads(spark.read.option("wholetext", True).text(path + "-model").first()[0])
        arrays = [np.array(stored[n]) for n in ("centres", "live", "generation")]
        return cls(path, stored["vector"], stored["pid"], arrays[0], [np.array(b) for b in stored["books"]], *arrays[1:])


def code_table(books: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squares of distances between the parts of a query and the entries of their code books."""
    return ((books - query.reshape(len(books), 1, -1)) ** 2).sum(axis=2)


def lloyd(rows: np.ndarray, book: np.ndarray, rounds: int) -> np.ndarray:
    """Task helper: k-means from the given start; a centre without rows stays where it is."""
    for _ in range(rounds):
        near = (((rows**2).sum(1)[:, None] - 2 * rows @ book.T) + (book**2).sum(1)).argmin(axis=1)
        count = np.bincount(near, minlength=len(book))
        used = count > 0
        sums = np.stack([np.bincount(near, rows[:, d], len(book)) for d in range(rows.shape[1])], axis=1)
        book[used] = sums[used] / count[used, None]
    return book


def _train_books(codes: int, rounds: int):
    """Task helper: k-means code book of one part of the training vectors."""

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        frame = frame.sort_values("order", kind="stable")
        rows = np.stack(frame["piece"].to_numpy()).astype("float64")
        book = lloyd(rows, rows[:codes].copy(), rounds)
        return pd.DataFrame({"part": [part] * len(book), "code": range(len(book)), "centre": list(book)})

    return train


def _encoder(books: np.ndarray):
    """Task helper: nearest code per part for a batch of vectors."""

    def encode(matrix: np.ndarray) -> np.ndarray:
        rows = matrix.reshape(len(matrix), len(books), -1)
        codes = np.empty((len(rows), len(books)), dtype="int16")
        for part, book in enumerate(books):
            codes[:, part] = ((book**2).sum(1) - 2 * rows[:, part] @ book.T).argmin(axis=1)
        return codes

    return encode


def train_books(training: DataFrame, parts: int, codes: int, width: int) -> np.ndarray:
    """Code books of the vectors ``(order, _vector)``, a bounded number of rows; one part per task."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    pieces = training.select("order", "_vector", starts)
    pieces = pieces.select("order", "part", F.slice("_vector", F.col("part") * width + 1, width).alias("piece"))
    trained = pieces.groupBy("part").applyInPandas(_train_books(codes, 15), "part int, code int, centre array<double>")
    return np.array([r["centre"] for r in sorted(trained.collect())]).reshape(parts, -1, width)


def build_index(
    df: DataFrame,
    path: str,
    vector: str,
    pid: Sequence[str],
    dims: int,
    cells: int = 256,
    parts: int = 16,
    codes: int = 256,
    training_rows: int = 65_536,
    seed: int = 0,
) -> VectorIndex:
    """Store ``df`` by k-means cell with one code per part of the vector.

    Centres and code books are trained on a random ``training_rows`` of the rows, a
    bound that keeps training constant; every row is then assigned, encoded and
    written by one distributed job. A crowded cell is split over several files. An index
    at ``path`` is replaced as a whole.
    """
    if dims % parts:
        raise ValueError(f"{dims} dimensions do not split into {parts} equal parts")
    spark, width = df.sparkSession, dims // parts
    keyed = df.select(F.xxhash64(*pid, F.lit(seed)).alias("order"), F.col(vector).alias("_vector"))
    # The same parts whatever the cluster, as the start of k-means depends on them.
    tasks = max(1, training_rows // _TRAINING_ROWS_PER_TASK)
    training = keyed.orderBy("order").limit(training_rows).repartitionByRange(tasks, "order").persist()
    rows = training.select(array_to_vector(F.col("_vector").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(rows)
    centres = np.array(model.clusterCenters())

    books = train_books(training, parts, codes, width)
    training.unpersist()

    index = VectorIndex(
        path, vector, list(pid), centres, [books], np.ones(len(centres), bool), np.zeros(len(centres), np.int64)
    )
    write_partitioned(index.coded(df), path, ["cell"])
    index.save(spark)
    return index
