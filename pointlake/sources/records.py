"""Records of plain text files whose quoted fields may hold newlines, read by many tasks.

A line ends a record if the quotes up to there are even in number. Every split of a file
counts its own quotes; a prefix sum over the splits tells each whether it starts inside
a quoted field, so all of them can be cut into records at the same time. What a split
holds of a record that begins or ends in another one is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SPLIT = ["file", "start", "length"]
_HEAD, _MIDDLE, _TAIL = range(3)  # what a split holds of a record that crosses its borders, in order

Split = tuple[str, int, int]


def split_openings(splits: list[tuple[str, int, int, int]]) -> dict[Split, int]:
    """Whether each split ``(file, start, length, quotes)`` starts inside a quoted field (1) or not."""
    opening: dict[Split, int] = {}
    for file, parts in groupby(sorted(splits), key=lambda s: s[0]):
        inside = 0
        for _, start, length, quotes in parts:
            opening[file, start, length] = inside
            inside = (inside + quotes) % 2
        if inside:
            raise ValueError(f"a quoted field of {file} has no end")
    return opening


def _cut_records(opening: dict[Split, int], crossing: bool):
    """Task helper: the records wholly inside a split, or, if ``crossing``, the parts of others."""

    def batch_of(texts, split: Split | None = None, kind: int | None = None) -> pa.RecordBatch:
        values = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        file, start, _ = split or (None, None, None)
        n = len(values)
        columns = [values, pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([kind] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["value", "file", "start", "kind"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: Split | None = None
        inside, head, held = 0, False, []

        def left() -> Iterator[pa.RecordBatch]:
            if held and crossing:
                yield batch_of(["\n".join(held)], split, _MIDDLE if head else _TAIL)

        for batch in batches:
            starts = batch.column(2).to_numpy()
            files = batch.column(1)
            changed = np.ones(len(starts), dtype=bool)
            same_file = pc.equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            changed[1:] = (starts[1:] != starts[:-1]) | ~same_file.astype(bool)
            edges = np.append(np.flatnonzero(changed), len(starts)).tolist()
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                here = (files[first].as_py(), int(starts[first]), batch.column(3)[first].as_py())
                if here != split:
                    yield from left()
                    if here not in opening:
                        raise RuntimeError("the files were split in another way than when their quotes were counted")
                    split, inside, held = here, opening[here], []
                    head = bool(inside)
                lines = batch.column(0).slice(first, end - first)
                odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
                if not inside and not odd.any():
                    if not crossing:
                        yield batch_of(lines)
                    continue
                states = (inside + np.cumsum(odd)) % 2
                inside = int(states[-1])
                texts, begin, records = lines.to_pylist(), 0, []
                for last in np.flatnonzero(states == 0).tolist():
                    record = "\n".join([*held, *texts[begin : last + 1]])
                    begin, held = last + 1, []
                    if not head:
                        records.append(record)
                    elif crossing:
                        yield batch_of([record], split, _HEAD)
                    head = False
                held += texts[begin:]
                if records and not crossing:
                    yield batch_of(records)
        yield from left()

    return cut


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: every record of the text files at ``path``, without its line end.

    Lines end with a newline, or a carriage return and a newline; both kinds stay as they
    are inside quotes. A quote inside a quoted field is doubled, and no unquoted field
    holds one, as in what databases export. Empty lines between records are left out.

    The quotes are counted by a first scan of the files when this is called; the driver
    holds a number for each split. Files without a quoted newline are then read in
    generated code alone. A field that never ends fails.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    block = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    lines = lines.select("value", *[c.alias(name) for c, name in zip(block, _SPLIT, strict=True)])
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    counted = lines.groupBy(*_SPLIT).agg(F.sum(odd).alias("quotes")).collect()
    opening = split_openings([(r["file"], r["start"], r["length"], r["quotes"]) for r in counted])
    if not any(r["quotes"] for r in counted):
        records = lines.select("value")
    else:
        schema = "value string, file string, start long, kind int"
        records = lines.mapInArrow(_cut_records(opening, False), schema).select("value")
        ordered = sorted(opening)
        # A split that starts inside a field, and the one before it.
        torn = {s for pair in zip(ordered, ordered[1:], strict=False) for s in pair if opening[pair[1]] and pair[0][0] == pair[1][0]}
        if torn:
            marks = spark.createDataFrame(sorted(torn), "file string, start long, length long")
            # One row a split at most.
            parts = lines.join(F.broadcast(marks), _SPLIT, "left_semi").select("value", *_SPLIT)
            parts = parts.mapInArrow(_cut_records(opening, True), schema)
            order = Window.partitionBy("file").orderBy("start", "kind")
            numbered = parts.withColumn("record", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
            pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "value")))
            joined = numbered.groupBy("file", "record").agg(pieces.alias("pieces"))
            records = records.union(joined.select(F.array_join("pieces.value", "\n").alias("value")))
    ended = F.expr("if(endswith(value, '\\r'), left(value, length(value) - 1), value)")
    return records.select(ended.alias("value")).filter("value <> ''")
