"""Group counts, distances to group means, and shard statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.columns import distance
from pointlake.operators.skew import HOT_ROWS, skew_join
from pointlake.workspace import Workspace


def groups_with_size(df: DataFrame, keys: Sequence[str], more_than: int, less_than: int) -> DataFrame:
    """``(keys, len)`` of groups with ``more_than < len < less_than``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))
    return counted.filter((F.col("len") > more_than) & (F.col("len") < less_than))


def with_group_mean(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "mean_", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add each row's group mean of ``columns``; a group of any size is split, not gathered."""
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).cast("double")).alias(f"{prefix}{c}") for c in columns]
    )
    # Stored, as the list of hot groups and the join both read it.
    means = Workspace(df.sparkSession).save(means, "means")
    hot = means.filter(F.col("_n") > hot_rows).select(*keys, "_n")
    return skew_join(df, means.drop("_n"), keys, hot=hot)


def with_distance_to_mean(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    name: str = "dist_to_mean",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the distance of each row to the mean of its group."""
    means = [f"mean_{c}" for c in columns]
    return with_group_mean(df, keys, columns, hot_rows=hot_rows).withColumn(name, distance(columns, means))


def nearest_to_mean(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], pid: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per group the real row nearest its mean; the smallest ``pid`` wins a tie."""
    measured = with_distance_to_mean(df, keys, columns, "_distance", hot_rows)
    best = F.min(F.struct("_distance", pid, *columns)).alias("_best")
    return measured.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (pid, *columns)])


def compression_ratio(labels: DataFrame, label: Sequence[str]) -> DataFrame:
    """Distinct labels per row, as ``ratio``.

    The distinct labels are counted as groups, so no task holds them all.
    """
    groups = labels.groupBy(*label).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg((F.count(F.lit(1)) / F.sum("_n")).alias("ratio"))


def sum_of_squares(df: DataFrame, column: str) -> DataFrame:
    """``sum(column * column)``; decimals keep it exact where a long would overflow."""
    value = F.col(column).cast("decimal(19,0)")
    return df.agg(F.sum(value * value).alias("sum_squares"))


def shard_metrics(points: DataFrame, files: DataFrame) -> DataFrame:
    """``(shard, shard_n_bytes, n_objects, n_points)``; objects are counted as groups."""
    objects = points.groupBy("shard", "root_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = objects.groupBy("shard").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("_n").alias("n_points"))
    sizes = files.groupBy("shard").agg(F.sum("n_bytes").alias("shard_n_bytes"))
    return sizes.join(counted, "shard", "left").select("shard", "shard_n_bytes", "n_objects", "n_points")
