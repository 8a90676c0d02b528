"""Partitioned Parquet tables with bloom filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter


# Bytes a filter may take per row group: the rate holds for 70 million bits' worth of
# values, about 9 million at 0.001. Smaller row groups get a smaller filter.
BLOOM_BYTES = 16 * 1024**2


def bloom_options(columns: Sequence[str], fpp: float = 0.001, max_bytes: int = BLOOM_BYTES) -> dict[str, str]:
    """Writer options for a bloom filter per column and row group.

    The writer tries filters of several sizes and keeps the smallest that meets ``fpp``
    for the values it has seen, up to ``max_bytes``; no distinct count has to be known.
    """
    if not columns:
        return {}
    options = {
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.bloom.filter.candidates.number": "8",
        "parquet.bloom.filter.max.bytes": str(max_bytes),
    }
    for column in columns:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.fpp#{column}"] = str(fpp)
    return options


def table_writer(
    df: DataFrame,
    partition_by: Sequence[str],
    mode: str,
    codec: str,
    rows_per_file: int,
    bloom: dict[str, str] | None,
    replace: str = "table",
) -> DataFrameWriter:
    """Writer whose overwrites replace the whole table, or only the partitions it writes."""
    if replace not in ("table", "partitions"):
        raise ValueError(f"unknown extent {replace!r} of an overwrite")
    writer = df.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", rows_per_file)
    extent = "static" if replace == "table" else "dynamic"
    writer = writer.option("partitionOverwriteMode", extent).options(**(bloom or {}))
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    mode: str = "overwrite",
    codec: str = "snappy",
    rows_per_file: int = 50_000_000,
    bloom: dict[str, str] | None = None,
    sort_by: Sequence[str] = (),
    clustered: bool = False,
    replace: str = "table",
) -> None:
    """One distributed write, clustered by partition.

    The rebalance brings a partition's rows together so each directory gets few
    files, and splits a partition that holds a large share of all rows over several
    tasks; ``clustered`` says ``df`` already is.

    ``mode="overwrite"`` starts from an empty table, or with ``replace="partitions"``
    replaces only the partitions present in ``df``, so that a rerun of some shards does
    not duplicate rows and leaves the others; ``append`` adds rows.
    """
    rows = df if clustered else df.hint("rebalance", *partition_by)
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    table_writer(rows, partition_by, mode, codec, rows_per_file, bloom, replace).parquet(path)
