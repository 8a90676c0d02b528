"""Benchmark decontamination: a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.text import mix, table, text_bytes, words
from pointlake.workspace import Workspace

WINDOW = 10
# Bytes of item text whose n-grams one broadcast carries. More items take more passes. The
# set takes six to twenty times the text, while it is built on the driver about thirty times.
BROADCAST_TEXT_BYTES = 16_000_000

HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>"


class NgramSet:
    """The n-grams of some items, by word numbers; small enough to broadcast.

    ``items`` holds ``(item_id, text)``. An item of fewer words than ``window``, but not
    none, is one n-gram of all its words. Beside the numbers of the distinct words there
    are only flat arrays: the items' words, and for each size a :class:`_Grams`.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names: list[str | None] = []
        texts, sizes = [], []
        for item_id, text in items:
            found = words(text)
            if found:
                number = self.numbers.setdefault
                texts.append(np.array([number(w, len(self.numbers)) for w in found], dtype=np.int32))
                sizes.append(min(window, len(found)))
                self.names.append(None if item_id is None else str(item_id))
        self.tokens = np.concatenate([*texts, np.zeros(0, dtype=np.int32)])
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        self.grams: dict[int, _Grams] = {}
        for size in sorted(set(sizes)):
            own = np.flatnonzero(np.array(sizes) == size)
            windows = lengths[own] - size + 1
            first = np.repeat(starts[own] - (np.cumsum(windows) - windows), windows)
            self.grams[size] = _Grams(self.tokens, first + np.arange(windows.sum()), np.repeat(own, windows), size)

    def find(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word ranges of ``tokens`` that items cover, merged, and the items' ids."""
        lookup = self.numbers.get
        seen = np.fromiter((lookup(w, -1) for w in tokens), dtype=np.int64, count=len(tokens))
        unknown = np.concatenate([[0], np.cumsum(seen < 0)])
        ranges: list[tuple[int, int]] = []
        owners = np.zeros(len(self.names), dtype=bool) if self.names else None
        for size, grams in self.grams.items():
            # Only windows without a word that no item has are worth a hash.
            at = np.flatnonzero(unknown[size:] == unknown[:-size]) if len(seen) >= size else []
            if len(at):
                at, found = grams.find(self.tokens, seen, at)
                ranges += zip(at.tolist(), (at + size).tolist(), strict=True)
                for g in np.unique(found).tolist():
                    owners[grams.items[grams.begins[g] : grams.begins[g + 1]]] = True
        if not ranges:
            return [], set()
        return merge_ranges(ranges), {self.names[i] for i in np.flatnonzero(owners)}


class _Grams:
    """Distinct n-grams of one size: their hashes, a place of each, and the items that hold it.

    ``hashes`` is sorted; ``places`` are starts in the items' words; the items of gram ``g``
    are ``items[begins[g] : begins[g + 1]]``.
    """

    def __init__(self, tokens: np.ndarray, places: np.ndarray, items: np.ndarray, size: int):
        self.size, self.seed = size, 0
        while True:
            hashes = _window_hashes((tokens[places + i] for i in range(size)), self.seed)
            order = np.lexsort((items, hashes))
            hashes, at, owner = hashes[order], places[order], items[order]
            same = hashes[1:] == hashes[:-1]
            alike = np.ones(same.sum(), dtype=bool)
            for i in range(size):
                alike &= tokens[at[1:][same] + i] == tokens[at[:-1][same] + i]
            if alike.all():
                break
            self.seed += 1  # two n-grams with one hash: hash anew
        new = np.concatenate([[True], ~same])
        self.hashes, self.places = hashes[new], at[new].astype(np.int32)
        kept = np.concatenate([[True], ~same | (owner[1:] != owner[:-1])])
        self.items = owner[kept].astype(np.int32)
        self.begins = np.append(np.flatnonzero(new[kept]), len(self.items)).astype(np.int32)

    def find(self, tokens: np.ndarray, seen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts among ``at`` where ``seen`` holds an n-gram, and its number; each is compared word by word."""
        found = _window_hashes((seen[at + i] for i in range(self.size)), self.seed)
        gram = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[gram] == found
        at, gram = at[hit], gram[hit]
        equal = np.ones(len(at), dtype=bool)
        for i in range(self.size):
            equal &= tokens[self.places[gram] + i] == seen[at + i]
        return at[equal], gram[equal]


def _window_hashes(columns: Iterable[np.ndarray], seed: int) -> np.ndarray:
    total = np.uint64(seed)
    for column in columns:
        total = mix(total + column.astype(np.uint64) + np.uint64(1))
    return total


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one."""
    merged: list[list[int]] = []
    for start, stop in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The items in as many blocks as their text needs; each fits the driver and a broadcast."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r["item_id"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect()]


def _scan(docs: DataFrame, grams: NgramSet, text: str) -> DataFrame:
    """``docs`` with a column ``hits``, or with what ``grams`` finds added to it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(grams)
    had = "hits" in docs.columns
    at, old = docs.columns.index(text), docs.columns.index("hits") if had else -1
    fields = [f for f in docs.schema.fields if f.name != "hits"]
    schema = T.StructType([*fields, T.StructField("hits", T._parse_datatype_string(HITS))])
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("item_ids", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(old).to_pylist() if had else [None] * batch.num_rows
            hits = []
            for value, known in zip(text_bytes(batch.column(at)), before, strict=True):
                tokens = words(value)
                spans, owners = shared.value.find(tokens)
                if known:
                    spans = merge_ranges(spans + [(s["start"], s["stop"]) for s in known["spans"]])
                    owners |= set(known["item_ids"])
                hits.append(
                    {
                        "n_words": len(tokens),
                        "n_hit": sum(b - a for a, b in spans),
                        "item_ids": sorted(owners - {None}),
                        "spans": [{"start": a, "stop": b} for a, b in spans],
                    }
                )
            kept = [c for i, c in enumerate(batch.columns) if i != old]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, type=kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BROADCAST_TEXT_BYTES,
    work: Workspace | None = None,
) -> DataFrame:
    """``docs`` with a struct ``hits``: ``n_words``, ``n_hit``, ``item_ids`` and word ``spans``.

    ``benchmark`` has ``item_id`` and ``text``. Every window of every document is looked
    up; a hash hit is compared word by word. Null or empty texts have no words and no
    hits; items without words match nothing; an item without an id marks words but is
    not listed. Repeated rows are judged one by one. A column ``hits`` of ``docs`` is
    replaced.

    The items are broadcast in blocks of ``block_bytes`` of text. One block is one scan
    without a shuffle; with more blocks each pass adds to a stored table.
    """
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    found = docs.drop("hits")
    for b, block in enumerate(_item_blocks(items, block_bytes)):
        if b:
            work = work or Workspace(docs.sparkSession)
            found = work.save(found, "hits")
        found = _scan(found, NgramSet(block, window), text)
    return found


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words in ``spans`` (word ranges) and what stands between them."""
    is_word = np.frombuffer(text.translate(_WORD_MASK), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_word, [0]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at : begins[start]])
        at = ends[stop - 1]
    return b"".join([*out, text[at:]])


_WORD_MASK = bytes(int(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contamination, in its own columns.

    ``remove="documents"`` drops a document with a hit; ``"spans"`` cuts the hit words out
    of ``text`` (named by the option ``text``) and keeps every document.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown mode {remove!r}")
    if "hits" in docs.columns:
        # The scan's own column has that name; the documents' one is kept under another.
        aside = max(docs.columns, key=len) + "_"
        cleaned = decontaminate(docs.withColumnRenamed("hits", aside), benchmark, remove, **options)
        return cleaned.withColumnRenamed(aside, "hits")
    text = options.get("text", "text")
    found = find_contamination(docs, benchmark, **options)
    if remove == "documents":
        return found.filter(F.col("hits.n_hit") == 0).select(*docs.columns)
    at, hits = found.columns.index(text), found.columns.index("hits")
    fields = [f for f in found.schema.fields if f.name != "hits"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [
                remove_spans(value, [(s["start"], s["stop"]) for s in hit["spans"]]) if hit["spans"] else value
                for value, hit in zip(text_bytes(batch.column(at)), batch.column(hits).to_pylist(), strict=True)
            ]
            columns = [pa.array(cut, type=pa.binary()).cast(pa.string()) if i == at else c
                       for i, c in enumerate(batch.columns) if i != hits]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, T.StructType(fields)).select(*docs.columns)


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words in benchmark passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.item_ids"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


DECONTAMINATION_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i : i + least(len(w), 10) - 1] AS gram
  FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i)
  WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM grams
), windows AS (
  SELECT row_id, i, size, w[i : i + size - 1] AS gram
  FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
), hits AS (
  SELECT row_id, i, windows.size, item_id FROM windows JOIN grams ON windows.gram = grams.gram
), covered AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM hits, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY row_id
), listed AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL)
  GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (row_id) LEFT JOIN listed USING (row_id)
"""

QUERIES = {"op2_decontamination": decontamination_query}
ORACLES = {"op2_decontamination": DECONTAMINATION_SQL}
