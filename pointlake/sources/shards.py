"""Zip shards: one archive per shard, one headerless CSV member per object."""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.columns import id_from_name

# Columns of a member before the embedding dimensions.
POINT_FIELDS = "node_id decimal(20,0), x float, y float, z float"
DIMENSIONS = 128
_BLOCK_BYTES = 1 << 22
# Archives up to this size are unpacked whole; of larger ones a task reads members of this size together.
WHOLE_BYTES = 1 << 27


def _member_points(dims: int, keep: int):
    """Task helper: the typed rows of some members of an archive, block by block."""
    kinds = {"node_id": pa.uint64(), **{c: pa.float32() for c in ("x", "y", "z")}}
    kinds |= {f"d{i}": pa.float32() for i in range(dims)}
    read = csv.ReadOptions(column_names=list(kinds), block_size=_BLOCK_BYTES, use_threads=False)
    convert = csv.ConvertOptions(column_types=kinds, null_values=[""])

    def vectors(rows: pa.RecordBatch) -> pa.Array:
        parts = [rows.column(4 + i) for i in range(keep)]
        values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in parts]).ravel()
        missing = None
        if any(c.null_count for c in parts):
            missing = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in parts]).ravel()
        offsets = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * keep)
        return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.float32), pa.float32(), mask=missing))

    def points(path: str, archive: zipfile.ZipFile, names: list[str]) -> Iterator[pa.RecordBatch]:
        for name in names:
            with archive.open(name) as member:
                if not member.peek(1):
                    continue
                first = 0
                for rows in csv.open_csv(member, read_options=read, convert_options=convert):
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * n, pa.string()),
                            pa.array([name] * n, pa.string()),
                            pa.array(np.arange(first, first + n)),
                            rows.column(0).cast(pa.decimal128(20, 0)),
                            *(rows.column(i) for i in (1, 2, 3)),
                            vectors(rows),
                        ],
                        names=["path", "member", "pid", "node_id", "x", "y", "z", "embedding"],
                    )
                    first += n

    return points


@contextlib.contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    """Task helper: an archive of which only the parts that are asked for are read."""
    files, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with files.open_input_file(place) as stream, zipfile.ZipFile(stream) as archive:
        yield archive


def _member_runs(task_bytes: int):
    """Task helper: the members of archives in runs of about ``task_bytes`` packed bytes, from their directories."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as archive:
                    runs, held = [[]], 0
                    for info in archive.infolist():
                        if runs[-1] and held + info.compress_size > task_bytes:
                            runs.append([])
                            held = 0
                        runs[-1].append(info.filename)
                        held += info.compress_size
                columns = [pa.array([path] * len(runs), pa.string()), pa.array(runs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "members"])

    return plan


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, path, n_bytes)`` of every archive; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(id_from_name("path").alias("shard"), "path", F.col("length").alias("n_bytes"))


def scan_shards(
    spark: SparkSession, path: str, dims: int = DIMENSIONS, keep: int | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Points of all archives: ``shard, root_id, pid, node_id, x, y, z, embedding``.

    An archive of up to ``whole_bytes`` is unpacked by one task. Of a larger one the
    directory at its end is read first, and its members are dealt to tasks in runs of
    about ``whole_bytes``, each of which reads only their part of the file, so there is no
    limit on its size; its file system has to be one that pyarrow opens. Members leave
    the Python worker as typed blocks. The rebalance after that keeps a shard's rows
    together but splits a large one over many tasks, so the rows are already clustered
    for a table partitioned by ``shard``. ``pid`` is the row number within the member;
    ``keep`` retains only the first dimensions. A value that is no number and a row of
    another length fail the job; an empty value is null.
    """
    points = _member_points(dims, keep or dims)
    schema = f"path string, member string, pid long, {POINT_FIELDS}, embedding array<float>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    yield from points(name, archive, archive.namelist())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as archive:
                    yield from points(name, archive, members)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(whole, schema)
    large = files.filter(F.col("length") > whole_bytes).select("path")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = large.mapInArrow(_member_runs(whole_bytes), "path string, members array<string>")
    # Dealt round by round of the members' hash, so that the runs of an archive are spread.
    spread = runs.repartition(partitions, F.xxhash64("path", "members")).mapInArrow(parts, schema)
    named = small.unionByName(spread).withColumn("shard", id_from_name("path")).drop("path").hint("rebalance", "shard")
    return named.select(
        "shard", id_from_name("member").alias("root_id"), "pid", "node_id", "x", "y", "z", "embedding"
    )
