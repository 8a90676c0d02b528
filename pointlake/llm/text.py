"""Small task helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z become a-z, digits, a-z and every byte of a non-ASCII character stay, all else is blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased.

    The pattern excludes only single-byte characters, so it can be applied byte by byte.
    """
    return text.translate(_WORD_BYTES).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit value per word, the same in every process."""
    values = np.empty(len(tokens), dtype=object)
    values[:] = tokens
    return pd.util.hash_array(values, categorize=False) if tokens else np.zeros(0, dtype=np.uint64)


# An odd constant with well spread bits; any such value would do.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(29))) * _SPREAD
    return x ^ (x >> np.uint64(32))


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most ``rows`` rows with about ``size`` bytes in column ``text``.

    What a task makes of texts is held for one run at a time; a longer text is a run of its own.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string or binary Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def crc32(column: str):
    """CRC-32 of a column's UTF-8 text."""
    return F.crc32(F.col(column).cast("binary"))
