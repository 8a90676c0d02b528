"""Contiguous and shuffled label numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.operators.skew import HOT_ROWS, skew_join

# Keys per numbering bucket. Keys are distinct within a group, so a bucket of this many
# consecutive integers is one bounded sort whatever the size of the group.
BUCKET_KEYS = 1 << 20


# Times that the buckets of 64-bit ids are gathered into larger ones to sum them up.
ID_LEVELS = 2


def _offsets(sizes: DataFrame, groups: Sequence[str], levels: int) -> DataFrame:
    """``(groups, _bucket, _before)``: the rows in the buckets before each one of ``sizes``.

    Buckets can be as many as rows where ids are far apart, so they are summed within
    runs of ``BUCKET_KEYS`` buckets first, and these among each other.
    """
    if not levels:
        before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    run = F.floor(F.col("_bucket") / F.lit(BUCKET_KEYS)).cast("long")
    inner = sizes.select(*groups, F.col("_bucket").alias("_inner"), run.alias("_bucket"), "_n")
    runs = inner.groupBy(*groups, "_bucket").agg(F.sum("_n").alias("_n"))
    at = F.struct(*groups, "_bucket").alias("_at")
    above = _offsets(runs, groups, levels - 1).select(at, F.col("_before").alias("_above"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    summed = inner.select(*groups, "_inner", at, F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_before"))
    placed = summed.join(above, "_at")
    return placed.select(*groups, F.col("_inner").alias("_bucket"), (F.col("_before") + F.col("_above")).alias("_before"))


def numbered(
    df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[str], name: str, levels: int = 0
) -> DataFrame:
    """Add the row number within each group in ``(bucket, order)`` order, starting at 0.

    Rows are numbered inside a bucket and shifted by the sizes of the buckets before
    it, so no task sorts a whole group. ``levels`` is ``ID_LEVELS`` for buckets of ids.
    """
    bucketed = df.withColumn("_bucket", bucket)
    cell = [*groups, "_bucket"]
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    sizes = bucketed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    # As a structure, so that rows of a group with a null in its name meet as well.
    at = F.struct(*cell).alias("_at")
    offsets = _offsets(sizes, groups, levels).select(at, "_before")
    number = (F.col("_before") + F.col("_local") - 1).alias(name)
    return local.withColumn("_at", at).join(offsets, "_at").select(*df.columns, number)


def id_bucket(key: str, bucket_keys: int = BUCKET_KEYS) -> Column:
    return F.floor(F.col(key) / F.lit(bucket_keys)).cast("long")


def contiguous_labels(
    clusters: DataFrame, groups: Sequence[str], key: str, name: str, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """Distinct ``(groups, key)`` with labels 0, 1, 2, ... in key order within each group."""
    distinct = clusters.select(*groups, key).distinct()
    return numbered(distinct, groups, id_bucket(key, bucket_keys), [key], name, ID_LEVELS)


def shuffled_labels(
    df: DataFrame, groups: Sequence[str], label: str, seed: int = 0, name: str = "shuffled", buckets: int = 1024
) -> DataFrame:
    """Mapping ``(groups, label, name)``: a pseudo-random permutation of the labels in use.

    The n-th label in label order receives the n-th label in hash order. Null is no label.
    """
    distinct = df.filter(F.col(label).isNotNull()).select(*groups, label).distinct()
    by_label = numbered(distinct, groups, id_bucket(label), [label], "_place", ID_LEVELS)
    hashed = distinct.withColumn("_hash", F.xxhash64(*groups, label, F.lit(seed)))
    by_hash = numbered(hashed, groups, F.pmod(F.col("_hash"), F.lit(buckets)), ["_hash", label], "_place")
    # As a structure, so that rows of a group with a null in its name meet as well.
    at = F.struct(*groups, "_place").alias("_at")
    targets = by_hash.select(at, F.col(label).alias(name))
    return by_label.withColumn("_at", at).join(targets, "_at").select(*groups, label, name)


def relabel(
    df: DataFrame, mapping: DataFrame, keys: Sequence[str], label: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Replace ``label`` by its ``name`` in the mapping; no row is lost.

    Keys are compared with nulls equal. A null label stays null; a label without an entry
    in the mapping fails the job.
    """
    at = F.struct(*keys, label).alias("_at")
    known = mapping.select(at, F.struct(F.col(name)).alias("_new"))
    joined = skew_join(df.withColumn("_at", at), known, ["_at"], "left", hot_rows=hot_rows)
    missing = F.raise_error(F.concat(F.lit(f"no {name} for {label} "), F.col(label).cast("string")))
    new = F.when(F.col(label).isNull(), F.lit(None)).when(F.col("_new").isNull(), missing).otherwise(F.col(f"_new.{name}"))
    return joined.withColumn(label, new.cast(mapping.schema[name].dataType)).drop("_at", "_new")
