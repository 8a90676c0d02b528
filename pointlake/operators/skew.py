"""Equi-join that splits keys holding very many rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.workspace import Workspace

# A key with more rows than this is split. At most rows / HOT_ROWS keys qualify, which
# bounds the list of hot keys that is broadcast.
HOT_ROWS = 1_000_000
# Tasks that a hot key of unknown size is spread over; a counted one gets a task for every
# HOT_ROWS / _PARTS of its rows.
SALTS = 64
_PARTS = 4


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct keys with more than ``hot_rows`` rows, and these as ``_n``; counts combine before the shuffle."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*on, "_n")


def stored_hot_keys(
    work: Workspace, df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame | bool:
    """Hot keys of a *stored* table, or ``False`` when it has none.

    The row count of a stored table comes from its footers; below ``hot_rows`` rows no
    key can be hot and nothing is scanned.
    """
    if df.count() <= hot_rows:
        return False
    hot = work.save(hot_keys(df, on, hot_rows), "hot")
    return False if hot.isEmpty() else hot


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | bool | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``left.join(right, on, how)`` for ``inner`` and ``left``, safe when ``left`` is skewed.

    Left rows of a hot key are spread by a hash of the row over as many tasks as their
    number asks for; right rows of a hot key are repeated once for each. Rows with a null
    key match nothing and are spread over all tasks. The salt depends on the row alone,
    so a retried task assigns it again. ``hot`` passes keys that the caller knows, with
    their counts as ``_n`` if it has them, or ``False`` when it knows there are none.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    if hot is False:
        return left.join(right, on, how).select(*columns)
    hot = hot if hot is not None else hot_keys(left, on, hot_rows)
    counted = F.ceil(F.col("_n") * _PARTS / max(hot_rows, 1)).cast("int") if "_n" in hot.columns else F.lit(salts)
    marks = F.broadcast(hot.select(*on, counted.alias("_salts")))
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.when(null_key, F.lit(partitions)).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*left.columns), parts).cast("int").alias("_salt")
    salted_left = left.join(marks, on, "left").select(*left.columns, salt)
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(marks, on, "left").select(*right.columns, F.explode(copies).alias("_salt"))
    return salted_left.join(salted_right, [*on, "_salt"], how).select(*columns)
