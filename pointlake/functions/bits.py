"""Bit interleaving: one sortable number from several bucket numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interleave(columns: Sequence[str], bits: int) -> Column:
    """Z-order value of long columns holding numbers from 0 to ``2**bits - 1``, as a long."""
    if bits * len(columns) > 63:
        raise ValueError("interleaved value does not fit a long")
    terms = [
        f"shiftleft(shiftright(`{column}`, {bit}) & 1L, {bit * len(columns) + place})"
        for bit in range(bits)
        for place, column in enumerate(columns)
    ]
    return F.expr(" | ".join(terms))
