"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks. Histograms of the scores, summed over
all tasks, narrow the range that holds each query's kth score until it is one value; rows
above it are results, and rows at it are taken in id order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import table
from pointlake.workspace import Workspace

K = 10
SCALE = 1024
QUERY_EVERY = 100
# Queries of one block, about: what is broadcast and what a task holds scores for at once.
BLOCK_QUERIES = 2048
BINS = 1024
RESULT = "query_id long, vec_id long, score long"
_ROWS = 1024  # candidate rows scored at a time


def scaled_ints(vector: str, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, or null if one is null or not finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale)))


@dataclass
class Block:
    """Queries with the score range ``[low, low + width)`` that holds each one's kth score.

    ``above`` counts the scores over the range; a query with fewer than k candidates has
    them all as results.
    """

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    width: int
    above: np.ndarray

    def scores(self, vectors: np.ndarray, exact: type) -> np.ndarray:
        return (self.vectors.astype(exact) @ vectors.astype(exact).T).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = pc.list_value_length(column).to_numpy()
    if (lengths != dims).any():
        raise ValueError(f"a vector has {lengths[lengths != dims][0]} components, the first query has {dims}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column(0).to_numpy(), _matrix(part.column(1), dims)


def _histogram(candidates: DataFrame, block: Block, dims: int, k: int, exact: type) -> DataFrame:
    """The bin of each query's range with its kth score, as ``(query, bin, above)``.

    ``above`` counts the scores over that bin. A query with fewer than k candidates has
    no row.

    A task reports its bins from the top down to its own kth score: no lower bin can hold
    the global kth, as the task alone has k scores above it.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        step = -(-b.width // BINS)
        counts = np.zeros((len(b.ids), BINS + 1), dtype=np.int64)  # the last bin is over the range
        rows = np.arange(len(b.ids))[:, None] * (BINS + 1)
        for ids, vectors in _pieces(batches, dims):
            scores = b.scores(vectors, exact)
            # Compared before subtracting: the difference of two longs may not be one.
            inside = scores >= b.low[:, None]
            inside &= ids[None, :] != b.ids[:, None]
            over = inside & (scores > b.low[:, None] + (b.width - 1))
            bins = np.where(over, BINS, np.where(inside, (scores - b.low[:, None]) // step, 0))
            counts += np.bincount((rows + bins)[inside], minlength=counts.size).reshape(counts.shape)
        down = counts[:, ::-1]
        reached = np.cumsum(down, axis=1) - down
        wanted = (down > 0) & (reached < k)
        query, place = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int64)), pa.array(BINS - place), pa.array(down[wanted])],
            names=["query", "bin", "n"],
        )

    parts = candidates.mapInArrow(run, "query long, bin long, n long")
    summed = parts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
    located = summed.withColumn("reached", reached).withColumn("above", F.col("reached") - F.col("n"))
    return located.filter((F.col("reached") >= k) & (F.col("above") < k)).select("query", "bin", "above")


def _narrow(block: Block, located: list) -> None:
    """Replace each query's range by the bin that holds its kth score."""
    step = -(-block.width // BINS)
    block.above = np.zeros(len(block.ids), dtype=np.int64)
    for r in located:
        block.low[r["query"]] += r["bin"] * step
        block.above[r["query"]] = r["above"]
    # A query without a kth score keeps its lowest value: all its scores are over it.
    block.width = step


def _select(candidates: DataFrame, block: Block, dims: int, k: int, exact: type) -> DataFrame:
    """Each task's scores over the kth, and its lowest ids at the kth, as results may need."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        need = k - b.above
        ties: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(b.ids)
        for ids, vectors in _pieces(batches, dims):
            scores = b.scores(vectors, exact)
            other = ids[None, :] != b.ids[:, None]
            query, at = np.nonzero((scores > b.low[:, None]) & other)
            yield _results(b.ids[query], ids[at], scores[query, at])
            equal = (scores == b.low[:, None]) & other
            for q in np.flatnonzero(equal.any(axis=1)):
                # Ids at the kth score: only the smallest that can still be needed are kept.
                ties[q] = np.sort(np.concatenate([ties[q], ids[equal[q]]]))[: need[q]]
        query = np.repeat(np.arange(len(b.ids)), [len(t) for t in ties])
        yield _results(b.ids[query], np.concatenate([*ties, []]).astype(np.int64), b.low[query])

    return candidates.mapInArrow(run, RESULT)


def _results(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, type=pa.int64()) for x in (query_id, vec_id, score)], names=["query_id", "vec_id", "score"]
    )


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    block_queries: int = BLOCK_QUERIES,
    work: Workspace | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest inner products.

    Both tables have ``vec_id`` and ``ints``, a list of integers of one length. Equal
    scores are ranked by the smaller ``vec_id``. A query's own id is no candidate, nor
    are rows whose ``ints`` or id is null, or ``ints`` empty; a query with fewer than ``k`` candidates gets
    them all. Rows repeated with the same id are candidates each, a repeated query is
    one. Rows with another number of components than the first query raise an error. No
    queries or no rows give an empty table.

    The queries are taken in blocks of about ``block_queries`` by a hash of the id, each
    broadcast to all rows. The work is queries times rows, as an exact search needs; what
    is shuffled is at most k bins or rows per query and task.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark)
    usable = (F.size("ints") > 0) & F.col("vec_id").isNotNull()
    rows = work.save(vectors.select(F.col("vec_id").cast("long"), F.col("ints").cast("array<long>")).filter(usable), "rows")
    asked = work.save(
        queries.select(F.col("vec_id").cast("long"), F.col("ints").cast("array<long>")).filter(usable).distinct(), "queries"
    )
    square = F.aggregate("ints", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    longest = rows.agg(F.max(F.sqrt(square)).alias("norm")).first()["norm"]
    count = asked.count()
    blocks = math.ceil(count / block_queries)
    # The blocks' results are folders of one table, so the plan does not grow with the queries.
    found = work.location("found")
    spark.createDataFrame([], RESULT).write.parquet(f"{found}/block=-1")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if part and longest is not None:
            _search(rows, part, k, longest).write.parquet(f"{found}/block={b}")
    kept = spark.read.schema(f"{RESULT}, block int").parquet(found).drop("block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, part: list, k: int, longest: float) -> DataFrame:
    vectors = np.array([r["ints"] for r in part], dtype=np.int64)
    dims = vectors.shape[1]
    # No score, nor a part of its sum, is larger than the product of the two lengths;
    # doubles add integers below 2^53 without rounding.
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    limit = int(norms.max() * longest * (1 + 1e-9)) + 1
    if limit >= 2**62:
        raise ValueError("scores do not fit a 64-bit integer")
    exact = np.float64 if limit < 2**53 else np.int64
    ids = np.array([r["vec_id"] for r in part], dtype=np.int64)
    block = Block(ids, vectors, np.full(len(ids), -limit, dtype=np.int64), 2 * limit + 1, np.zeros(len(ids), dtype=np.int64))
    while block.width > 1:
        _narrow(block, _histogram(rows, block, dims, k, exact).collect())
    return _select(rows, block, dims, k, exact)


def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every hundredth embedding."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled_ints("embedding").alias("ints"))
    found = exact_top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op5_topk": top_k_query}
ORACLES = {"op5_topk": TOP_K_SQL}
