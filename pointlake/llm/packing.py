"""Best-fit packing planned on a histogram of lengths.

Only the histogram, at most one row per possible length, reaches the driver. It decides
how many pieces of each length go where; a piece then takes the slot of its rank among
the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pointlake.llm.text import table
from pointlake.llm.tokens import VOCABULARY, decoded, encoder
from pointlake.workspace import Workspace

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Slots:
    """Ranks from ``rank`` on lie ``per_sequence`` to a sequence, from ``sequence``, at ``offset``."""

    rank: int
    sequence: int
    per_sequence: int
    offset: int


def plan_best_fit(histogram: Mapping[int, int], capacity: int) -> tuple[dict[int, list[Slots]], int]:
    """Slots by length, and the number of sequences, of best-fit decreasing.

    Sequences with the same room are kept as ranges of numbers, so the work depends on
    the number of lengths, not of pieces. The next piece of a length goes where the least
    room is left that holds it. That is the sequence just used as long as it holds
    another, so a sequence takes as many as it holds before the next one is touched.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
    order: list[int] = []
    plan: dict[int, list[Slots]] = {}
    sequences = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((first, many))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left, rank, slots = histogram[length], 0, []
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room = capacity
                first, many = sequences, -(-left // (capacity // length))
                sequences += many
            per = room // length
            full = min(many, left // per)
            rest = min(left - full * per, per - 1) if full < many else 0
            slots.append(Slots(rank, first, per, capacity - room))
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), many - full - (rest > 0))
            rank += full * per + rest
            left -= full * per + rest
        plan[length] = slots
    return plan, sequences


def cut_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of the encoded documents, each ended by ``end_id``.

    A document longer than ``capacity`` is cut into pieces of that length; the first may
    be shorter. ``ids`` holds little-endian unsigned 32-bit ids. ``part`` and ``local``
    number the pieces of a length inside a task; they are stable only once stored. A null
    text is empty and gives one piece, the end id alone. Repeated rows give their own
    pieces; an empty table gives none.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            *T._parse_datatype_string(
                "piece int, start long, length long, ids binary, part int, local long"
            ).fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(vocabulary), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            done = 0
            for texts in decoded(batch, 1):
                owner, rows = [], []
                for i, value in enumerate(texts):
                    ids = encode(value)
                    ids.append(end_id)
                    data = np.array(ids, dtype="<u4").tobytes()
                    first = len(ids) % capacity or capacity
                    for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                        stop = start + capacity if piece else first
                        size = stop - start
                        owner.append(done + i)
                        rows.append((piece, start, size, data[4 * start : 4 * stop], part, seen[size]))
                        seen[size] += 1
                columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, type=pa.int64()))]
                    + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                    names=schema.names,
                )
                done += len(texts)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, work: Workspace | None = None) -> DataFrame:
    """``pieces`` of :func:`cut_documents` with ``sequence_id`` and ``offset``.

    Any columns but ``length``, ``part`` and ``local`` are carried along, so a caller can
    replace the ids by a digest first. Sequences are filled without gaps from 0.

    The pieces are stored once: ranks have to come from the same numbering if an executor
    is lost. The shuffle joins pieces to the first rank of their length and task; a length
    that many documents share is spread over the tasks that read them.
    """
    work = work or Workspace(pieces.sparkSession)
    stored = work.save(pieces, "pieces")
    cells = work.save(stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "cells")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most one row for each length up to the capacity.
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_best_fit(histogram, capacity)
    ranked = stored.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("local"))
    carried = [c for c in pieces.columns if c not in ("part", "local")]
    return _take_slots(ranked.select(*carried, "rank"), plan)


def _take_slots(ranked: DataFrame, plan: Mapping[int, list[Slots]]) -> DataFrame:
    """Each row's place by its length and rank. The plan's size depends on the capacity alone."""
    by_length = {
        length: tuple(np.array([getattr(s, f) for s in slots], dtype=np.int64)
                      for f in ("rank", "sequence", "per_sequence", "offset"))
        for length, slots in plan.items()
    }
    shared = ranked.sparkSession.sparkContext.broadcast(by_length)
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*fields, *T._parse_datatype_string("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at_length).to_numpy()
            ranks = batch.column(at_rank).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(rows):
                    continue
                length = int(lengths[rows[0]])
                first, base, per, start = shared.value[length]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                step = ranks[rows] - first[at]
                sequence[rows] = base[at] + step // per[at]
                offset[rows] = start[at] + length * (step % per[at])
            kept = [c for i, c in enumerate(batch.columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, ids as their CRC-32."""
    pieces = cut_documents(table(spark, sf_dir, "documents"))
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(digested).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES = {"op8_packing": packing_query}
