"""Enrichment of a table by id, and the work still missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.columns import require_columns
from pointlake.operators.skew import skew_join


def enrich(
    table: DataFrame, extra: DataFrame, key: str = "id", suffix: str = "_right", hot_rows: int | None = None
) -> DataFrame:
    """Left join on ``key``; columns of ``extra`` that collide get ``suffix``.

    Rows without a key match nothing, and are spread over all tasks instead of meeting
    in one. A repeated key is left to adaptive execution, which splits it while the
    join runs; looking for one beforehand would parse a dump twice. ``hot_rows`` asks
    for that look where the table is stored and one id is known to repeat.
    """
    require_columns(table, [key])
    require_columns(extra, [key])
    renamed = {c: f"{c}{suffix}" for c in extra.columns if c != key and c in table.columns}
    extra = extra.withColumnsRenamed(renamed)
    if hot_rows is not None:
        return skew_join(table, extra, [key], "left", hot_rows=hot_rows)
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*table.columns), F.lit(partitions)).cast("int")
    left = table.withColumn("_salt", F.when(F.col(key).isNull(), spread).otherwise(F.lit(0)))
    joined = left.join(extra.withColumn("_salt", F.lit(0)), [key, "_salt"], "left")
    return joined.select(*table.columns, *[c for c in extra.columns if c != key])


def remaining_items(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected items with no row in ``done``.

    Completed keys are reduced to distinct ones first, so a key written many times
    costs one row after the shuffle.
    """
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")
