"""Samples per group and single-query nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_per_group(
    df: DataFrame, group: Sequence[str], n: int, key: Sequence[str], seed: int = 0, order: Column | None = None
) -> DataFrame:
    """``n`` pseudo-random rows of every group; a smaller group is returned whole.

    Rows are ordered by a hash of ``key`` and ``seed`` (or by ``order``), so the same
    seed gives the same sample. Spark applies the limit inside each task before the
    shuffle, so a very large group sends at most ``n`` rows per task.
    """
    order = order if order is not None else F.xxhash64(*key, F.lit(seed))
    ranked = Window.partitionBy(*group).orderBy(order, *key)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")
