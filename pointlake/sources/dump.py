"""Headerless CSV dumps described by a sidecar file."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.columns import decode_booleans, drop_columns
from pointlake.sources.records import quoted_records
from pointlake.sources.schema import boolean_fields, build_schema, read_sidecar

# Bookkeeping columns of a dump that are dropped when present.
DROP_COLUMNS = ("created", "deleted", "superceded_id", "valid")

# An empty field is null but a quoted empty one is the empty string; the reader only
# tells them apart when the null marker is a text no dump contains.
_NULL_MARKER = "\u0001null\u0001"
# Endings of files that cannot be read from the middle.
_COMPRESSED = re.compile(r"\.(gz|deflate|snappy|lz4|zst)$")


def scan_dump(
    spark: SparkSession,
    table_path: str,
    sidecar_path: str,
    drop: Sequence[str] = DROP_COLUMNS,
    multiline: bool = True,
) -> DataFrame:
    """Scan of a dump, optionally compressed; only the quotes of its lines are counted at once.

    A bad value and a row with too few or too many fields fail the job, also where the
    columns concerned are dropped: every field of every row is parsed. A quoted newline
    is part of its value. Plain files are split across tasks all the same, see
    ``quoted_records``; a dump known to have no quoted newline can set
    ``multiline=False``, which saves the count. A compressed file is unpacked by one task
    and its records are spread before they are parsed.
    """
    fields = read_sidecar(spark, sidecar_path)
    options = {
        "header": "false", "escape": '"', "mode": "FAILFAST", "nullValue": _NULL_MARKER, "emptyValue": "",
    }
    schema = build_schema(fields)
    if multiline:
        records = quoted_records(spark, table_path)
        if any(_COMPRESSED.search(name) for name in records.inputFiles()):
            records = records.hint("rebalance")
        parsed = F.from_csv("value", schema.toDDL(), options | {"multiLine": "true"})
        table = records.select(parsed.alias("row")).select("row.*")
    else:
        table = spark.read.schema(schema).options(**options, columnPruning=False).csv(table_path)
    return decode_booleans(drop_columns(table, drop), boolean_fields(fields))
