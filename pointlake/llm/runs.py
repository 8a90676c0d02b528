"""Periodic runs of words, by seeds on the diagonals of a document and their extension.

A run of period ``q`` repeats its words at lag ``q``, so its first words and those ``q``
later agree over at least its least length less ``q``. Lags are taken in classes
``(L, 2L]``, and the words of a document are indexed by grams of that guaranteed overlap.
Such a gram is no shorter than a period, so inside a run it comes back after exactly one
period: pairs of *neighbouring* occurrences hold every run, and there are at most as many
of them as words. A pair is extended along its lag to both sides unless the table of the
furthest word covered at that lag says that an earlier pair has been there already.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.text import slices, table, text_bytes

# A run has at least this many words, and at least this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
# Words compared at once when a pair is extended; doubles while they agree.
_STRIDE = 16


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _pair_names(names: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the grams made of the grams at ``at`` and ``at + step``, and the sorted order.

    ``names`` numbers the shorter grams by position, -1 where a gram is unique or leaves
    the text. A position counts only if both parts occur again.
    """
    at = at[at + step < len(names)]
    at = at[names[at + step] >= 0]
    key = names[at] * np.int64(len(names)) + names[at + step]
    order = np.argsort(key, kind="stable")
    return at[order], key[order]


def _doubled(names: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the grams of twice the length, and the positions of those that occur again."""
    place, key = _pair_names(names, at, step)
    same = key[1:] == key[:-1]
    again = np.append(same, False) | np.insert(same, 0, False) if len(key) else np.zeros(0, bool)
    number = np.cumsum(np.insert(~same, 0, True)) if len(key) else np.zeros(0, np.int64)
    longer = np.full(len(names), -1, dtype=np.int64)
    longer[place[again]] = number[again]
    return longer, np.sort(place[again])


def _seeds(names: np.ndarray, at: np.ndarray, width: int, gram: int, low: int, high: int):
    """Neighbouring occurrences ``(lag, first word)`` of a gram, their lag in ``low..high``.

    A gram of ``gram`` words is two overlapping ones of ``width``. Pairs that only move
    the one before by a word are the same diagonal, so their first one stands for them.
    """
    place, key = _pair_names(names, at, gram - width)
    lag = place[1:] - place[:-1]
    use = (key[1:] == key[:-1]) & (lag >= low) & (lag <= high)
    lag, first = lag[use], place[:-1][use]
    order = np.lexsort((first, lag))
    lag, first = lag[order], first[order]
    fresh = np.ones(len(lag), dtype=bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
    return zip(lag[fresh].tolist(), first[fresh].tolist(), strict=True)


def _agreeing(ids: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many words from ``at`` on, forwards or backwards, equal those ``lag`` later."""
    room = len(ids) - lag - at if way > 0 else at + 1
    total, stride = 0, _STRIDE
    while total < room:
        n = min(stride, room - total)
        low = at + total if way > 0 else at - total - n + 1
        differs = ids[low : low + n] != ids[low + lag : low + lag + n]
        if differs.any():
            return total + int(np.argmax(differs if way > 0 else differs[::-1]))
        total, stride = total + n, stride * 2
    return total


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[Run]:
    """Every run of ``words``, sorted by start, then period.

    A run is a stretch that no neighbouring word extends with the same smallest period,
    of at least ``min_words`` words and ``min_periods`` (3 or more) periods. Takes
    ``n log n`` time in the worst case and memory for a few numbers a word.
    """
    if min_periods < 3:
        raise ValueError("neighbouring occurrences hold every run of three periods or more only")
    n, runs = len(words), []
    if n < min_words:
        return runs
    ids = pd.factorize(words)[0].astype(np.int64)
    names, at, width = ids, np.arange(n), 1
    low = high = 1
    while low * min_periods <= n and len(at):
        # The least overlap of a run with itself, one period later, over the lags of the class:
        # it falls with the lag while ``min_words`` decides, and rises after that.
        turn = min(max(min_words // min_periods, low), high)
        gram = min(max(min_words, min_periods * q) - q for q in (turn, min(turn + 1, high)))
        while 2 * width <= gram:
            names, at = _doubled(names, at, width)
            width *= 2
        covered: dict[int, int] = {}
        for lag, first in _seeds(names, at, width, gram, low, high):
            if first < covered.get(lag, -1):
                continue
            start = first - _agreeing(ids, first - 1, lag, -1) if first else 0
            end = first + _agreeing(ids, first, lag, 1)
            covered[lag] = end
            length = end - start + lag
            if length >= max(min_words, min_periods * lag):
                runs.append(Run(start, length, lag))
        low, high = high + 1, high * 2
    return sorted(runs, key=lambda r: (r.start, r.period))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps only its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def document_runs(text: bytes | None) -> tuple[list[bytes], list[Run]]:
    """The words of a text (white space ``[\\x20\\x09-\\x0D]`` parts them) and its runs."""
    words = (text or b"").split()
    if len(words) < MIN_WORDS:
        return words, []
    return words, find_runs(np.array(words, dtype=object))


_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` and the ``collapsed`` text (UTF-8) of every document.

    ``runs`` holds ``(start, length, period)`` in words from 0, sorted by start, then
    period. In ``collapsed`` every run keeps its first period only, and one blank parts
    the words. A null, empty or blank text has no word, no run and an empty ``collapsed``.
    Rows are handled one by one, so repeated rows and ids, null ids and columns of any
    name change nothing; an empty table gives no rows. A text is held by one task as a
    whole, and no row is shuffled.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {_SCHEMA}"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                counts, found, collapsed = [], [], []
                for words, runs in map(document_runs, text_bytes(batch.column(1))):
                    counts.append(len(words))
                    found.append([r._asdict() for r in runs])
                    if runs:
                        words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.binary())],
                    names=[key, "n_words", "runs", "collapsed"],
                )

    return docs.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``periodic_runs``: how many runs, the strongest, and two hashes.

    The strongest has the most periods, compared exactly; ties go to the smaller start, then period.
    """
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n"))))
    best = F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),"
        " (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    return found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        key,
        "n_runs",
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# White space between words, as the splitting of bytes has it.
_BLANKS = "[\\x20\\x09-\\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; every tenth document by its id's CRC-32 ends periodically.

    There each word from the ``a``-th on becomes word ``a + (i - a) % p``. A document
    without an id or a word stays as it is.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _BLANKS), lambda w: w != "")
    planted = docs.select("doc_id", "text", crc32_of_id().alias("h"))
    planted = planted.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    sized = planted.select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").alias("n"))
    some = F.col("n") > 0
    placed = sized.withColumn("a", F.when(some, F.expr("g % n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # Word by word in the array; positions before a stay.
    periodic = F.expr(
        "concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])))"
    )
    return placed.select("doc_id", F.when(some, periodic).otherwise(F.col("text")).alias("text"))


def crc32_of_id() -> Column:
    """CRC-32 of the id's decimal digits; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which were made periodic first."""
    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {"op11_runs": runs_query}

ORACLES = {
    "op11_runs": r"""
WITH RECURSIVE crc_table AS (
  SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(b)),
crc AS (
  SELECT doc_id, doc_id::VARCHAR AS digits, 0 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL
  SELECT r.doc_id, r.digits, r.i + 1, xor(t.v, r.c >> 8)
  FROM crc r JOIN crc_table t ON t.b = xor(r.c, ascii(r.digits[r.i + 1])) & 255 WHERE r.i < length(r.digits)),
hashed AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(digits)),
lists AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
own AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM lists),
sized AS (
  SELECT l.doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g
  FROM lists l JOIN hashed h ON h.doc_id = l.doc_id),
moved AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS origin
  FROM (SELECT *, unnest(range(n)) AS i FROM sized)),
words AS (SELECT m.doc_id, m.n, m.i, o.word FROM moved m JOIN own o ON o.doc_id = m.doc_id AND o.i = m.origin),
-- A run of period q agrees with itself at lag q over two periods from a multiple of q on.
lags AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM sized),
anchors AS (SELECT doc_id, q, unnest(range(0, n - 3 * q + 1, q)) AS i FROM lags),
likely AS (
  SELECT DISTINCT s.doc_id, s.q FROM anchors s
  JOIN words a ON a.doc_id = s.doc_id AND a.i = s.i
  JOIN words b ON b.doc_id = s.doc_id AND b.i = s.i + s.q AND b.word = a.word
  JOIN words c ON c.doc_id = s.doc_id AND c.i = s.i + 2 * s.q AND c.word = a.word
  JOIN words d ON d.doc_id = s.doc_id AND d.i = s.i + s.q - 1
  JOIN words e ON e.doc_id = s.doc_id AND e.i = s.i + 2 * s.q - 1 AND e.word = d.word
  JOIN words f ON f.doc_id = s.doc_id AND f.i = s.i + 3 * s.q - 1 AND f.word = d.word),
agreeing AS (
  SELECT l.doc_id, l.q, a.i, a.i - row_number() OVER (PARTITION BY l.doc_id, l.q ORDER BY a.i) AS island
  FROM likely l JOIN words a ON a.doc_id = l.doc_id JOIN words b ON b.doc_id = l.doc_id AND b.i = a.i + l.q AND b.word = a.word),
stretches AS (
  SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM agreeing
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches d WHERE d.doc_id = r.doc_id AND d.q < r.q AND r.q % d.q = 0 AND d.s <= r.s AND d.s + d.len >= r.s + r.len)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (
  SELECT r.* FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.len * r.q > r.len * o.q
      OR o.len * r.q = r.len * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM runs r JOIN words w ON w.doc_id = r.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len),
collapsed AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM words w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period,
       1000 * b.len // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM sized s LEFT JOIN listed l ON l.doc_id = s.doc_id LEFT JOIN best b ON b.doc_id = s.doc_id
LEFT JOIN collapsed c ON c.doc_id = s.doc_id
""",
}
