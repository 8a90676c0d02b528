"""Zipped embedding shards to raw, condensed and mapping tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointlake.functions.columns import keep_dims
from pointlake.operators.condense import condense
from pointlake.operators.search import build_index
from pointlake.sinks.partitioned import write_partitioned
from pointlake.sources.shards import DIMENSIONS, list_shards, scan_shards
from pointlake.workspace import Workspace


@dataclass(frozen=True)
class LakePaths:
    raw: str
    condensed: str
    maps: str
    vectors: str

    @classmethod
    def below(cls, root: str) -> LakePaths:
        return cls(f"{root}/raw_embeddings", f"{root}/condensed_embeddings", f"{root}/condensation_maps", f"{root}/vectors")


def shards_to_lake(
    spark: SparkSession,
    shard_path: str,
    out: str,
    threshold: float = 60.0,
    dims: int = DIMENSIONS,
    keep: int = 64,
    index: Mapping[str, int] | None = None,
    **options,
) -> LakePaths:
    """Write the three tables, each partitioned by ``shard``.

    All shards and objects go through together. The raw table keeps every dimension
    and is what the later steps read; the first ``keep`` dimensions are condensed.
    Running the same shards again replaces their partitions instead of adding rows.
    ``index`` asks for a vector index of the condensed table, of all shards in it, and
    holds the options of :func:`pointlake.operators.search.build_index`. ``options`` go to :func:`pointlake.operators.condense.condense`.
    """
    paths = LakePaths.below(out)
    write_partitioned(scan_shards(spark, shard_path, dims), paths.raw, ["shard"], clustered=True, replace="partitions")
    raw = spark.read.parquet(paths.raw)
    # One row per archive of this run; the raw table may hold shards of earlier runs.
    current = list_shards(spark, shard_path).select(F.col("shard").cast("int").alias("shard")).distinct()
    raw = raw.withColumn("shard", F.col("shard").cast("int")).join(current, "shard", "left_semi")
    points = raw.select("shard", "root_id", "pid", "x", "y", "z", keep_dims("embedding", keep).alias("embedding"))
    points = points.withColumn("shard", F.col("shard").cast("long"))
    work = Workspace(spark)
    condensed, mapping = condense(points, threshold, keep, work=work, **options)
    write_partitioned(condensed, paths.condensed, ["shard"], replace="partitions")
    write_partitioned(mapping, paths.maps, ["shard"], replace="partitions")
    work.delete()
    if index is not None:
        vectors = spark.read.parquet(paths.condensed)
        build_index(vectors, paths.vectors, "embedding", ["shard", "root_id", "condensed_id"], keep, **index)
    return paths
