"""Scans of lake tables and id lookups that prune partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_lake(spark: SparkSession, path: str) -> DataFrame:
    """Scan a table; unsigned 64-bit ids, which arrive as decimals, become longs."""
    table = spark.read.parquet(path)
    wide = [f.name for f in table.schema.fields if f.dataType.simpleString() == "decimal(20,0)"]
    return table.withColumns({name: F.col(name).cast("long") for name in wide}) if wide else table


def lookup(df: DataFrame, column: str, values: Sequence[int], n_partitions: int) -> DataFrame:
    """Rows whose id is in ``values``, reading only the partitions those ids hash to.

    A filter on the id alone does not prune ``<column>_partition``; the derived
    predicate does, and min-max or bloom statistics then act inside the partitions.
    """
    partitions = sorted({value % n_partitions for value in values})
    return df.filter(F.col(f"{column}_partition").isin(partitions) & F.col(column).isin(list(values)))
