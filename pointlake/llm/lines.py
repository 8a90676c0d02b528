"""Line dedup on hashes, with DataFrame operations only.

Each line becomes a hash of its key. Hashes are range-partitioned and sorted by document
and position, so one pass over a partition sees the first document of every line and
marks the occurrences in all others. What comes back is a compressed bitmap per document,
not text: the marks of 64 lines in a number, and runs of lines without a mark left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import table
from pointlake.workspace import Workspace

# Lines with shorter keys are never dropped.
MIN_CHARACTERS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "\t\n\x0b\x0c\r "
# Coarse buckets of hashes, in which lines that are too frequent for one task are looked for.
_BUCKETS = 1 << 16
# A line is hot from this share of a partition's rows on; so hot lines number 4 a partition at most.
_HOT_SHARE = 4


def split_lines(text: str = "text") -> Column:
    """Lines of a text, parted at each newline; null and empty ones are one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARACTERS) -> DataFrame:
    """``(h1, h2, doc, version, place)`` of every line with a key of ``least`` characters or more.

    A key is the line stripped of ASCII white space, A-Z lower-cased; ``h1`` and ``h2`` are
    128 bits of it. ``version`` is a hash of the text, so that rows that share an id can
    hold different texts.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    lines = docs.select(
        F.col(key).alias("doc"), text_version(text).alias("version"), F.posexplode(F.split(lowered, "\n", -1)).alias("place", "line")
    )
    keyed = lines.select("doc", "version", "place", F.btrim("line", F.lit(_BLANKS)).alias("line"))
    keyed = keyed.filter(F.char_length("line") >= least)
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "version", "place")


def text_version(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_lines(stored: DataFrame, partitions: int) -> DataFrame:
    """``(h1, h2, first)`` of lines with too many occurrences for one task, and their first document.

    Occurrences are counted in coarse buckets of the hash first; only buckets that could
    hold such a line are counted by line. Both counts combine before the shuffle, and
    there are at most ``4 * partitions`` such buckets and lines, which bounds what is
    broadcast.
    """
    most = max(1, stored.count() // (_HOT_SHARE * partitions))
    bucket = F.pmod(F.col("h1"), F.lit(_BUCKETS))
    crowded = stored.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > most).select("bucket")
    inside = stored.withColumn("bucket", bucket).join(F.broadcast(crowded), "bucket", "left_semi")
    counts = inside.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    return counts.filter(F.col("n") > most).select("h1", "h2", "first")


def repeated_lines(occurrences: DataFrame, work: Workspace) -> DataFrame:
    """``(doc, version, place)`` of occurrences of a line in other documents than its first.

    Ids are compared as they are and a null id comes last. All of a document's own lines
    stay if it is the first, however often it repeats them.
    """
    stored = work.save(occurrences, "lines")
    partitions = _partitions(occurrences.sparkSession)
    hot = F.broadcast(work.save(hot_lines(stored, partitions), "hot"))
    later = ~F.col("doc").eqNullSafe(F.col("first"))
    common = stored.join(hot, ["h1", "h2"]).filter(later)
    rest = stored.join(hot, ["h1", "h2"], "left_anti").repartitionByRange(partitions, "h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc"), "place")
    first = F.first("doc").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rest.withColumn("first", first).filter(later)
    return common.select("doc", "version", "place").union(marked.select("doc", "version", "place"))


def drop_bitmaps(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", least: int = MIN_CHARACTERS) -> DataFrame:
    """``(doc, version, n_dropped, marks)`` of each document that loses lines.

    ``marks`` lists ``(word, bits)`` in order: bit ``b`` of word ``w`` is set if line
    ``64 * w + b`` goes. Words without a mark are left out. Rows with the same id and text
    are one entry.
    """
    dropped = repeated_lines(line_occurrences(docs, key, text, least), work)
    word, bit = F.expr("place div 64").cast("int"), F.expr("shiftleft(1L, place % 64)")
    words = dropped.groupBy("doc", "version", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    marks = F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("marks")
    return words.groupBy("doc", "version").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), marks)


def expanded(marks: str = "marks") -> Column:
    """The marks as one number for each 64 lines up to the last mark."""
    return F.expr(
        f"flatten(transform({marks}, (m, i) -> concat("
        f"array_repeat(0L, m.word - if(i = 0, 0, {marks}[i - 1].word + 1)), array(m.bits))))"
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARACTERS,
                work: Workspace | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without repeated lines.

    A line whose key has at least ``least`` characters and occurs in two documents or more
    stays in the one of the smallest id only, with all its repeats there; other lines stay.
    Documents are told apart by their id: rows that share one are one document, and rows
    without an id are one more, after all others. A null or empty text is one empty line
    and ``kept`` as an empty text; an empty table gives no rows. Columns of ``docs`` that
    are called like the new ones are replaced.
    """
    new = ("n_lines", "n_dropped", "kept")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    bitmaps = drop_bitmaps(docs, work or Workspace(docs.sparkSession), key, text, least)
    bitmaps = bitmaps.select("doc", "version", "n_dropped", expanded().alias("bits"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), text_version(text).alias("of"))
    # A document of many rows is spread, as the bitmap side may be split where rows crowd.
    joined = rows.join(bitmaps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("of") == F.col("version")), "left")
    kept = F.expr(
        "if(bits is null, coalesce(text, ''), array_join(filter(split(text, '\\n', -1),"
        " (line, i) -> (shiftright(coalesce(get(bits, i div 64), 0L), i % 64) & 1) = 0), '\\n'))"
    )
    found = joined.select("row", F.col(f"row.`{text}`").alias("text"), "n_dropped", "bits")
    return found.select(
        "row.*",
        F.size(split_lines()).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps of its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_lines": lines_query}

ORACLES = {
    "op12_lines": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) <> max(doc_id)),
marked AS (
  SELECT k.doc_id, k.place, k.line, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
