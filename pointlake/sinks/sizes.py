"""Bytes stored per layout."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.columns import projected_gigabytes


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of every data file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length")


def stored_bytes(spark: SparkSession, path: str) -> int:
    return list_files(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def storage_by_layout(spark: SparkSession, layouts: Mapping[str, str]) -> DataFrame:
    """``(format, size_bytes)`` for named folders."""
    listed = [list_files(spark, p).withColumn("format", F.lit(name)) for name, p in layouts.items()]
    return reduce(DataFrame.unionByName, listed).groupBy("format").agg(F.sum("length").alias("size_bytes"))


def unpivot_sizes(wide: DataFrame) -> DataFrame:
    """One row of totals to ``(format, size_bytes)`` rows."""
    return wide.unpivot([], wide.columns, "format", "size_bytes")


def with_projection(sizes: DataFrame, total: int, measured: int) -> DataFrame:
    """Add the size expected for all ``total`` shards when ``measured`` were written."""
    return sizes.withColumn("projected_size_gigabytes", projected_gigabytes("size_bytes", total, measured))
