"""Arithmetic on fixed-length vector columns, kept inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(column: str, query: Sequence[float]) -> Column:
    """Squared distance to a constant vector, one term per dimension."""
    deltas = [f"(cast(`{column}`[{i}] as double) - {float(value)!r}D)" for i, value in enumerate(query)]
    return F.expr(" + ".join(f"{d} * {d}" for d in deltas))


def mean_vector_by(df: DataFrame, keys: Sequence[str], vector: str, dims: int, *aggregates: Column) -> DataFrame:
    """Element-wise mean per group as ``vector``, with any further ``aggregates``.

    A null element or vector is left out of the means it would be part of; a mean of
    nulls alone is null. One sum and count per dimension: partial ones are combined
    before the shuffle, no row is exploded, and a group costs one buffer per task.
    """
    own = [F.expr(f"avg(cast(`{vector}`[{i}] as double)) as _mean{i}") for i in range(dims)]
    grouped = df.groupBy(*keys).agg(*own, *aggregates)
    means = ", ".join(f"cast(_mean{i} as float)" for i in range(dims))
    kept = [c for c in grouped.columns if not c.startswith("_mean")]
    return grouped.select(*kept, F.expr(f"array({means})").alias(vector))


def array_stats(column: str) -> dict[str, Column]:
    """Mean, population deviation, sum and size of each row's array; no shuffle.

    Each is one pass over the array: the mean and the squares about it are updated
    element by element. A null element makes the row's statistics null.
    """

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        square = acc["square"] + (x - acc["mean"]) * (x - mean)
        return F.struct(n.alias("n"), mean.alias("mean"), square.alias("square"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))
    std = F.aggregate(column, start, step, lambda acc: F.sqrt(acc["square"] / acc["n"]))
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)
    size = F.size(column)
    return {"mean": total / size, "std": std, "sum": total, "size": size}
