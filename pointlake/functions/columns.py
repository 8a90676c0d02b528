"""Reusable projections over scalar, array and name columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION_SUFFIX = "pt_position"
XYZ_COLUMNS = ("x", "y", "z")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name!r} not found; available columns: {df.columns}")


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop ``names``; with ``strict`` a missing one is an error."""
    if strict:
        require_columns(df, names)
    return df.drop(*names)


def decode_booleans(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``t`` and ``f`` to booleans, anything else to null; absent columns are skipped."""
    present = [name for name in names if name in df.columns]
    return df.withColumns(
        {name: F.when(F.col(name) == "t", True).when(F.col(name) == "f", False) for name in present}
    )


def with_literals(df: DataFrame, values: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Add constant columns given as ``{name: (value, type)}``."""
    return df.withColumns({name: F.lit(value).cast(dtype) for name, (value, dtype) in values.items()})


def position_columns(df: DataFrame) -> list[str]:
    """Packed point columns; already split ``_x``/``_y``/``_z`` columns do not match."""
    return [name for name in df.columns if name.endswith(POSITION_SUFFIX)]


def id_partition(column: Column | str, n_partitions: int = 256) -> Column:
    """Bounded, non-negative partition number of an id; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(column, F.lit(n_partitions)).cast("int")


def with_id_partitions(df: DataFrame, names: Sequence[str], n_partitions: int) -> DataFrame:
    """Add ``<name>_partition`` for each id column."""
    require_columns(df, names)
    return df.withColumns({f"{name}_partition": id_partition(name, n_partitions) for name in names})


def pack(*names: str) -> Column:
    """Several scalar columns as one array."""
    return F.array(*names)


def unpack(df: DataFrame, vector: str, position: str = "pos", value: str = "value") -> DataFrame:
    """One row per vector element, positions starting at 0."""
    others = [name for name in df.columns if name != vector]
    return df.select(*others, F.posexplode(vector).alias(position, value))


def fixed_vector(column: Column | str, dims: int, element: str = "float") -> Column:
    """Cast to ``array<element>``; a row of another length is an error."""
    column = F.col(column) if isinstance(column, str) else column
    cast = column.cast(f"array<{element}>")
    wrong = F.raise_error(F.concat(F.lit(f"expected {dims} elements, got "), F.size(column).cast("string")))
    return F.when(column.isNull() | (F.size(column) == dims), cast).otherwise(wrong.cast(f"array<{element}>"))


def keep_dims(column: Column | str, length: int, start: int = 0) -> Column:
    """``length`` elements from the 0-based position ``start``."""
    return F.slice(column, start + 1, length)


def projected_gigabytes(size: Column | str, total: int, measured: int) -> Column:
    """Bytes measured on ``measured`` parts, scaled to ``total`` parts, in GiB."""
    size = F.col(size) if isinstance(size, str) else size
    return size * F.lit(total / measured) / F.lit(1024.0**3)


def id_from_name(column: Column | str) -> Column:
    """Numeric id before the first dot of a file or member name."""
    base = F.element_at(F.split(column, "/"), -1)
    return F.split(base, r"\.")[0].cast("long")


def distance(left: Sequence[str], right: Sequence[str]) -> Column:
    """Euclidean distance between two tuples of coordinate columns."""
    return F.sqrt(squared_distance(left, right))


def squared_distance(left: Sequence[str], right: Sequence[str]) -> Column:
    total = None
    for a, b in zip(left, right, strict=True):
        delta = F.col(a) - F.col(b)
        total = delta * delta if total is None else total + delta * delta
    return total
