"""Decoding of hex-encoded WKB points."""

from __future__ import annotations

import binascii
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.columns import position_columns

# Fixed values of the WKB format: 8 bytes per ordinate, three ordinates at the end of
# the record; type word 1 is a point, ISO adds 1000 for z, the extended form sets a flag.
ORDINATE_BYTES = 24
POINT = 1
ISO_Z = 1001
EXTENDED_Z_FLAG = 0x80000000
EXTENDED_SRID_FLAG = 0x20000000


def _check_header(header: bytes, size: int) -> None:
    word = int.from_bytes(header[1:], "little" if header[0] else "big")
    if word & ~EXTENDED_SRID_FLAG not in (POINT | EXTENDED_Z_FLAG, ISO_Z):
        raise ValueError(f"not a three-dimensional WKB point: {header.hex()}")
    expected = 5 + ORDINATE_BYTES + (4 if word & EXTENDED_SRID_FLAG else 0)
    if size != expected:
        raise ValueError(f"WKB point of {size} bytes, expected {expected}")


def _same_length(texts: pa.Array, digits: int) -> np.ndarray:
    """Ordinates of points with equally long texts, parsed as one buffer."""
    if digits % 2:
        raise ValueError(f"WKB point of {digits} hex digits")
    if digits < 10:
        raise ValueError(f"WKB point of {digits // 2} bytes")
    start = texts.offset * digits
    text = texts.buffers()[2][start : start + len(texts) * digits]
    records = np.frombuffer(binascii.unhexlify(text), dtype="uint8").reshape(len(texts), digits // 2)
    # One check per distinct header: a batch normally holds a single one.
    for header in np.unique(records[:, :5], axis=0):
        _check_header(header.tobytes(), digits // 2)
    ordinates = np.ascontiguousarray(records[:, -ORDINATE_BYTES:]).view("<f8")
    return np.where(records[:, :1] == 0, ordinates.byteswap(), ordinates)


def decode_points(texts: pa.Array) -> pa.Array:
    """Integer ``[x, y, z]`` per hex point; null and empty texts give null."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    points = np.zeros((len(texts), 3))
    for digits in np.unique(sizes[sizes > 0]):
        mine = sizes == digits
        points[mine] = _same_length(texts.filter(pa.array(mine)), int(digits))
    if not (np.abs(np.trunc(points)) <= np.iinfo(np.int32).max).all():
        raise ValueError("point coordinate does not fit a 32-bit integer")
    filled = sizes > 0
    offsets = np.concatenate([[0], np.cumsum(filled * 3)]).astype("int32")
    values = pa.array(points[filled].astype("int32").ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~filled))


def decode_point(column: Column | str) -> Column:
    """Hex WKB point to ``array<int>`` of three, truncated toward zero; null stays null."""
    return F.arrow_udf(decode_points, "array<int>")(column)


def decode_positions(df: DataFrame, skip: Collection[str] = ()) -> DataFrame:
    """Decode every packed position column but those of ``skip``."""
    names = [name for name in position_columns(df) if name not in skip]
    return df.withColumns({name: decode_point(name) for name in names}) if names else df


def encode_point(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """Little-endian hex WKB point of three numbers; the inverse, for writing dumps."""

    def encode(xs: pa.Array, ys: pa.Array, zs: pa.Array) -> pa.Array:
        header = bytes([1]) + (POINT | EXTENDED_Z_FLAG).to_bytes(4, "little")
        xyz = np.column_stack([c.to_numpy(zero_copy_only=False) for c in (xs, ys, zs)]).astype("<f8")
        heads = np.broadcast_to(np.frombuffer(header, dtype="uint8"), (len(xyz), len(header)))
        text = np.hstack([heads, xyz.view("uint8")]).tobytes().hex()
        width = 2 * (len(header) + ORDINATE_BYTES)
        return pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())

    return F.arrow_udf(encode, "string")(x, y, z)
