"""Database dump to a partitioned, clustered, bloom-filtered table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pointlake.functions.columns import require_columns, with_id_partitions
from pointlake.functions.geometry import decode_positions
from pointlake.operators.joins import enrich
from pointlake.sinks.partitioned import BLOOM_BYTES, bloom_options, write_partitioned
from pointlake.sinks.zorder import zorder_rewrite
from pointlake.sources.dump import DROP_COLUMNS, scan_dump
from pointlake.workspace import Workspace

Dump = tuple[str, str]


def prepared_dump(
    spark: SparkSession,
    table: Dump,
    partition_columns: Sequence[str],
    n_partitions: int,
    segmentation: Dump | None = None,
    drop: Sequence[str] = DROP_COLUMNS,
) -> DataFrame:
    """Typed, enriched and decoded rows with their partition numbers; nothing runs yet."""
    # Decoded before the join: a point as text takes twice the bytes in its shuffle.
    rows = decode_positions(scan_dump(spark, *table, drop=drop))
    if segmentation:
        extra = scan_dump(spark, *segmentation, drop=drop)
        # A position that both have is renamed by the join and stays text.
        rows = enrich(rows, decode_positions(extra, skip=rows.columns))
    require_columns(rows, partition_columns)
    return with_id_partitions(rows, partition_columns, n_partitions)


def dump_to_lake(
    spark: SparkSession,
    table: Dump,
    out: str,
    partition_columns: Sequence[str] = ("pt_root_id",),
    n_partitions: int = 64,
    segmentation: Dump | None = None,
    zorder_columns: Sequence[str] = (),
    bloom_columns: Sequence[str] = (),
    fpp: float = 0.001,
    rows_per_file: int = 50_000_000,
    codec: str = "zstd",
    bloom_bytes: int = BLOOM_BYTES,
) -> DataFrame:
    """Write the table and return a scan of it. ``table`` and ``segmentation`` are
    ``(csv path, sidecar path)`` pairs.

    A table at ``out`` is replaced as a whole. Clustering needs quantiles of the joined rows, so they are stored once, unshuffled,
    and one range shuffle then produces the final files.
    """
    rows = prepared_dump(spark, table, partition_columns, n_partitions, segmentation)
    partition_by = [f"{c}_partition" for c in partition_columns]
    bloom = bloom_options(bloom_columns, fpp, bloom_bytes)
    if zorder_columns:
        require_columns(rows, zorder_columns)
        work = Workspace(spark)
        staged = work.location("staged")
        rows.write.mode("overwrite").option("compression", codec).parquet(staged)
        zorder_rewrite(spark, staged, out, zorder_columns, partition_by, codec=codec, bloom=bloom, rows_per_file=rows_per_file)
        work.delete()
    else:
        write_partitioned(rows, out, partition_by, codec=codec, rows_per_file=rows_per_file, bloom=bloom)
    return spark.read.parquet(out)
