"""Sidecar files: ``field,dtype`` rows naming the SQL type of each dump column."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# SQL type names a sidecar may hold and the column type each becomes.
SQL_TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "integer": T.IntegerType(),
    "smallint": T.ShortType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "numeric": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "character varying": T.StringType(),
    "date": T.DateType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampType(),
    "user-defined": T.StringType(),
}

_ARGUMENTS = re.compile(r"\s*\(([^)]*)\)")


def normalize_type(sql_type: str) -> str:
    """Trimmed lower-case type name without its parenthesised arguments."""
    return " ".join(_ARGUMENTS.sub(" ", sql_type).lower().split())


def column_type(sql_type: str) -> T.DataType:
    """Spark type of a SQL type name; a declared numeric precision is kept."""
    name = normalize_type(sql_type)
    if name not in SQL_TYPES:
        raise ValueError(f"unrecognized SQL type {name!r}; valid types: {', '.join(sorted(SQL_TYPES))}")
    arguments = _ARGUMENTS.search(sql_type)
    if name == "numeric" and arguments:
        precision, _, scale = arguments.group(1).partition(",")
        return T.DecimalType(int(precision), int(scale or 0))
    return SQL_TYPES[name]


def boolean_fields(fields: Iterable[tuple[str, str]]) -> list[str]:
    return [name for name, dtype in fields if normalize_type(dtype) == "boolean"]


def build_schema(fields: Iterable[tuple[str, str]], booleans_as_text: bool = True) -> T.StructType:
    """Schema of a dump; booleans stay text because dumps spell them ``t`` and ``f``."""
    schema = T.StructType()
    for name, dtype in fields:
        spark_type = column_type(dtype)
        if booleans_as_text and isinstance(spark_type, T.BooleanType):
            spark_type = T.StringType()
        schema = schema.add(name, spark_type, True)
    return schema


def read_sidecar(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rows of a sidecar file in file order: one per column of one table, so a few dozen."""
    rows = spark.read.option("quote", '"').csv(path).select("_c0", "_c1").collect()
    return [(row[0].strip(), row[1]) for row in rows]
