"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are permuted inside their partition, partition ``p`` sends exactly ``matrix[p][s]``
rows to shard ``s``, and each shard is permuted again. The matrix is one draw of the
multivariate hypergeometric law with the given partition and shard sizes, so all
assignments of rows to slots are equally likely while every shard has its exact size.
The rows never leave DataFrame operations.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import crc32, table
from pointlake.workspace import Workspace

SHARDS = 16
# Rows that one task numbers in a shard, about; a shard has as many buckets as that takes.
BUCKET_ROWS = 1_000_000
# Partitions whose counts go into one part of the stored matrix.
PLAN_PARTS = 10_000
_POSITION_BITS = 33  # monotonically_increasing_id() keeps the position in its low 33 bits


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most; the first shards get the extra rows."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, drawn from ``good + bad`` without return, are good.

    Inverts the distribution function outwards from the mode, so it takes about as many
    steps as the standard deviation and works for counts of any size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - peak
    down = up = mode
    below = above = peak
    while left > 0 and (down > low or up < high):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= above
            if left <= 0:
                return up
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= below
            if left <= 0:
                return down
        if above == below == 0.0:
            break
    return mode


def communication_matrix(partition_rows: Iterable[int], shard_rows: list[int], seed: int) -> Iterator[list[int]]:
    """Rows that each partition sends to each shard: one hypergeometric draw, a partition at a time."""
    rng = random.Random(seed)
    open_rows = list(shard_rows)
    for rows in partition_rows:
        rest, sent = sum(open_rows), []
        for shard, room in enumerate(open_rows):
            rest -= room
            take = hypergeometric(rng, room, rest, rows)
            sent.append(take)
            rows -= take
            open_rows[shard] -= take
        yield sent


def _stored_matrix(work: Workspace, counts: DataFrame, sizes: list[int], seed: int, plan_parts: int) -> DataFrame:
    """``(part, ends)``: for each partition the position at which each shard's share ends.

    The counts come to the driver a Spark partition at a time and go back as a table,
    ``plan_parts`` rows at a time, so that neither the driver nor a plan holds the matrix.
    """
    spark = work.spark
    target = work.location("matrix")
    spark.range(0).select(F.col("id").alias("part"), F.array("id").alias("ends")).write.parquet(target)
    ahead, behind = itertools.tee((r["part"], r["rows"]) for r in counts.orderBy("part").toLocalIterator())
    drawn = communication_matrix((rows for _, rows in ahead), sizes, seed)
    rows = ({"part": p, "ends": list(itertools.accumulate(sent))} for (p, _), sent in zip(behind, drawn))
    for n in itertools.count():
        some = list(itertools.islice(rows, plan_parts))
        if not some:
            break
        told = F.from_json(F.lit(json.dumps(some)), "array<struct<part:bigint,ends:array<bigint>>>")
        spark.range(1).select(F.inline(told)).write.parquet(f"{target}-{n}")
    return spark.read.schema("part bigint, ends array<bigint>").parquet(target, *(f"{target}-{i}" for i in range(n)))


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 0,
    work: Workspace | None = None,
    bucket_rows: int = BUCKET_ROWS,
    plan_parts: int = PLAN_PARTS,
) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most, and every assignment of the rows to slots is
    equally likely. Columns of ``docs`` called ``shard`` or ``slot`` are replaced.
    Repeated rows and nulls are rows like any other; an empty table gives no rows.

    The rows are written once, in their local order, so that counts and slots come from
    the same stored partitions even if executors are lost or join in between. The driver
    draws the counts of one partition after the other and stores them as a table.
    """
    spark: SparkSession = docs.sparkSession
    work = work or Workspace(spark)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    place = F.monotonically_increasing_id()
    # First permutation: each partition is ordered by a hash of where its rows came from.
    mixed = docs.select(F.struct(*own).alias("row"), F.xxhash64(F.lit(seed), place).alias("key"))
    local = mixed.sortWithinPartitions("key").select("row", place.alias("place"))
    stored = work.save(local, "permuted").select(
        "row",
        F.shiftright("place", _POSITION_BITS).alias("part"),
        F.col("place").bitwiseAND((1 << _POSITION_BITS) - 1).alias("position"),
    )
    counts = work.save(stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "counts")
    sizes = shard_sizes(counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], shards)
    plan = _stored_matrix(work, counts, sizes, seed, plan_parts)
    # Exchange: position r of partition p goes to the shard whose share of p holds r.
    buckets = max(1, math.ceil(max(sizes) / bucket_rows), math.ceil(4 * _partitions(spark) / shards))
    draw = F.xxhash64(F.lit(seed + 1), "part", "position")
    sent = stored.join(plan, "part").select(
        "row",
        F.size(F.filter("ends", lambda end: end <= F.col("position"))).alias("shard"),
        F.pmod(draw, F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed + 2), "part", "position").alias("key"),
        "part",
        "position",
    )
    # Second permutation: a random bucket, then a random order in it; the buckets follow
    # each other, so the slots of a shard have no gap and no task holds a whole shard.
    filled = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "part", "position")
    numbered = sent.withColumn("rank", F.row_number().over(inside))
    placed = numbered.join(offsets, ["shard", "bucket"])
    return placed.select("row.*", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32("text").alias("text_crc32"),
    )
    return shuffle_into_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_sharding": sharding_query}
