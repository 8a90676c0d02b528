"""Work items as DataFrames: ranges, file listings, or any query result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def range_items(spark: SparkSession, n: int, chunks: int | None = None) -> DataFrame:
    """``item`` from 0 to ``n - 1``, split into equal chunks."""
    return spark.range(0, n, 1, chunks).withColumnRenamed("id", "item")


def file_items(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One ``item`` per file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return files.option("recursiveFileLookup", True).load(path).select(F.col("path").alias("item"))


def normal_arrays(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """``(array_id, value)`` rows of ``n`` standard normal arrays."""
    cells = spark.range(n * length)
    return cells.select(
        F.floor(F.col("id") / length).cast("long").alias("array_id"), F.randn(seed).alias("value")
    )
