"""Rewrite of a table so that rows close in several columns share files."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions.bits import interleave
from pointlake.functions.columns import require_columns
from pointlake.sinks.partitioned import table_writer
from pointlake.sinks.sizes import stored_bytes

_SMALLEST_FILE = 8 * 1024**2
# Rows that a task sorts at most. Narrow rows are stored in a small part of what they take
# in a sort, about 130 bytes for a dozen numbers, so stored bytes alone do not bound it.
_SORTED_ROWS = 4_000_000


def _as_double(df: DataFrame, column: str) -> Column:
    """A number in the order of the column's values; text goes by its first six bytes."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType | T.BinaryType):
        # In this encoding each byte is a character of the same number; none counts as zero.
        head = F.decode(F.substring(value.cast("binary"), 1, 6), "ISO-8859-1")
        places = [F.ascii(F.substring(head, i + 1, 1)) * F.lit(256.0 ** (5 - i)) for i in range(6)]
        return reduce(lambda a, b: a + b, places)
    return value.cast("double")


def zorder_edges(df: DataFrame, columns: Sequence[str], bits: int = 8, error: float = 0.001) -> list[list[float]]:
    """Quantile edges of each column, on which its buckets begin."""
    require_columns(df, columns)
    filled = 2 ** min(bits, 63 // len(columns)) - 1
    doubles = {f"_d{i}": _as_double(df, c) for i, c in enumerate(columns)}
    quantiles = [q / filled for q in range(1, filled)]
    bounds = df.select(*[e.alias(n) for n, e in doubles.items()]).approxQuantile(list(doubles), quantiles, error)
    return [sorted(set(edges)) for edges in bounds]


def with_zorder(
    df: DataFrame, columns: Sequence[str], bits: int = 8, error: float = 0.001, edges: Sequence[Sequence[float]] | None = None
) -> DataFrame:
    """Add ``_z``: interleaved quantile buckets, nulls in a bucket of their own below the rest.

    The null bucket is one of the ``2**bits``, which keeps the quantile halves on the
    halves of the curve. ``edges`` passes stored ones, so that rows of later get the
    buckets of earlier ones.
    """
    require_columns(df, columns)
    bits = min(bits, 63 // len(columns))
    bounds = zorder_edges(df, columns, bits, error) if edges is None else edges
    doubles = {f"_d{i}": _as_double(df, c) for i, c in enumerate(columns)}
    df = df.withColumns(doubles)
    buckets = {}
    for name, own in zip(doubles, bounds, strict=True):
        splits = [-math.inf, *own, math.inf]
        bucketizer = Bucketizer(splits=splits, inputCol=name, outputCol=f"{name}b", handleInvalid="keep")
        df = bucketizer.transform(df)
        ranked = F.col(f"{name}b").cast("long") + 1
        buckets[f"{name}r"] = F.when(F.col(name).isNull(), F.lit(0).cast("long")).otherwise(ranked)
    coded = df.withColumns(buckets).withColumn("_z", interleave(list(buckets), bits))
    return coded.drop(*doubles, *[f"{n}b" for n in doubles], *buckets)


@dataclass
class ZOrderLayout:
    """How a table in ranges of the curve is laid out: edges of the columns, and where ranges begin."""

    path: str
    columns: list[str]
    partition_by: list[str]
    bits: int
    edges: list[list[float]]
    cuts: list[int]

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the place on the curve, ``_z``, and the range of it, ``z_range``."""
        coded = with_zorder(df, self.columns, self.bits, edges=self.edges)
        cuts = F.lit(self.cuts) if self.cuts else F.array().cast("array<bigint>")
        return coded.withColumn("z_range", F.size(F.filter(cuts, lambda cut: cut <= F.col("_z"))))

    def write(self, df: DataFrame, codec: str, replace: str) -> None:
        """One write in the order of the curve; a range with many rows is split over tasks."""
        keys = [*self.partition_by, "z_range"]
        ordered = df.hint("rebalance", *keys).sortWithinPartitions(*keys, "_z").drop("_z")
        table_writer(ordered, keys, "overwrite", codec, 50_000_000, None, replace).parquet(self.path)

    def save(self, spark: SparkSession) -> None:
        text = json.dumps(asdict(self))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.path + "-zorder")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ZOrderLayout:
        return cls(**json.loads(spark.read.option("wholetext", True).text(path + "-zorder").first()[0]))


def zorder_table(
    df: DataFrame, target: str, columns: Sequence[str], partition_by: Sequence[str] = (), bits: int = 8, ranges: int = 64,
    codec: str = "zstd",
) -> ZOrderLayout:
    """Write ``df`` in ``ranges`` of the z-order curve, one folder each, to which ``zorder_merge`` can add rows.

    The folders are a partition column ``z_range``. Edges and ranges are stored beside the
    table and stay as they are; write the table anew when rows of another kind crowd a few
    ranges. An existing table is replaced.
    """
    layout = ZOrderLayout(target, list(columns), list(partition_by), bits, zorder_edges(df, columns, bits), [])
    coded = layout.placed(df)
    steps = [i / ranges for i in range(1, ranges)]
    layout.cuts = sorted({int(z) for z in coded.approxQuantile("_z", steps, 1 / (4 * ranges))}) if steps else []
    layout.write(layout.placed(df), codec, "table")
    layout.save(df.sparkSession)
    return layout


def zorder_merge(spark: SparkSession, rows: DataFrame, target: str, codec: str = "zstd") -> list[int]:
    """Add ``rows`` to a table of ``zorder_table``; only the ranges that receive rows are written anew.

    Rows get the stored buckets. The folders they fall into are read, put in order with
    them and replaced in one write; all other files stay. Returns the ranges concerned.
    """
    layout = ZOrderLayout.load(spark, target)
    coming = layout.placed(rows)
    # Folders, of which a table has as many as ranges and values of its partition columns.
    keys = [*layout.partition_by, "z_range"]
    folders = coming.select(*keys).distinct().collect()
    if not folders:
        return []
    touched = reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]) for r in folders],
    )
    table = spark.read.parquet(target)
    held = layout.placed(table.filter(touched).drop("z_range"))
    layout.write(held.unionByName(coming.select(*held.columns)), codec, "partitions")
    return sorted({r["z_range"] for r in folders})


def _ranges(spark: SparkSession, table: DataFrame, source: str, file_bytes: int, rows_per_file: int) -> int:
    """Ranges to write the stored ``table`` in, one task each; its bytes and rows are not read but listed."""
    size, rows = stored_bytes(spark, source), table.count()
    whole = math.ceil(size / _SMALLEST_FILE)
    # A table too small to fill every core with whole files is split finer, and so is one
    # whose ranges would be cut into several files anyway.
    finer = min(max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_file)), whole)
    return max(1, math.ceil(size / file_bytes), math.ceil(rows / _SORTED_ROWS), finer)


def zorder_rewrite(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    bits: int = 8,
    file_bytes: int = 256 * 1024**2,
    files: int | None = None,
    codec: str = "zstd",
    bloom: dict[str, str] | None = None,
    rows_per_file: int = 50_000_000,
) -> None:
    """Write ``source`` to ``target`` in z-order within each partition.

    The target is replaced as a whole. Ranges also split on the row's place in its source file, so a single z value
    holding a large share of the rows still spreads over many tasks. ``files`` ranges are made if it is given, else
    as many as files of ``file_bytes``, or more where their rows would not fit a sort in memory.
    """
    table = spark.read.parquet(source)
    files = _ranges(spark, table, source, file_bytes, rows_per_file) if files is None else files
    placed = table.select("*", F.col("_metadata.row_index").alias("_row"))
    coded = with_zorder(placed, columns, bits)
    ranged = coded.repartitionByRange(files, *partition_by, "_z", "_row")
    ordered = ranged.sortWithinPartitions(*partition_by, "_z").drop("_z", "_row")
    table_writer(ordered, partition_by, "overwrite", codec, rows_per_file, bloom).parquet(target)
