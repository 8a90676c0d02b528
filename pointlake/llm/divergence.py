"""How far the word use of each source departs from its peers', by row accumulation.

Groups are the sources of a language and terms its words. Terms are dealt into slices,
each slice a term-major index of who uses a term how often. A group's row of divergences
is accumulated in a dense array over its peers: the terms of the group are scattered
through the index, so a pair of postings is added up where it is met and never becomes a
row. A term that a group lacks still has a share there, its baseline; what peers would
get if nobody used a term is added once, and the scatter corrects it where they do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import slices, table, text_bytes
from pointlake.workspace import Workspace

# Documents of a language that a term occurs in, at least, to be kept.
MIN_DOCUMENTS = 3
# Shares are counted in this part of one.
SCALE = 1_000_000_000
# Ranks of the terms that are reported for a group.
TERM_RANKS = 200
# Postings in a slice of the index, about: what a task holds at a time.
SLICE_POSTINGS = 250_000
# Distinct words of groups that a task counts before it hands them on.
_HELD_TERMS = 300_000
# Pairs of postings that are scattered at a time, and pairs of sources handed on at once.
_SCATTERED = 1_000_000
_HELD_PAIRS = 100_000

# A-Z become a-z, a-z and every byte of a non-ASCII character stay, all else is blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def group_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, uses, documents)`` of every group, and one row without a term for each.

    Null text, language or source is the empty one. Tasks count before the shuffle, in
    parts of bounded size, and each row of ``docs`` is a document of its own.
    """
    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).cast("binary").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter] = {}
        documents: dict[tuple[str, str], Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for group, found in uses.items():
                n = len(found) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[0]] * n, pa.string()),
                        pa.array([group[1]] * n, pa.string()),
                        pa.array([None, *found], pa.binary()).cast(pa.string()),
                        pa.array([0, *found.values()], pa.int64()),
                        pa.array([0, *map(documents[group].__getitem__, found)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "uses", "documents"],
                )
            uses.clear()
            documents.clear()

        for whole in batches:
            for batch in slices(whole, 2):
                for group, value in zip(
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True),
                    text_bytes(batch.column(2)),
                    strict=True,
                ):
                    own = Counter(terms(value))
                    held = uses.setdefault(group, Counter())
                    for term, n in own.items():
                        held[term] += n
                    documents.setdefault(group, Counter()).update(own.keys())
                if sum(map(len, uses.values())) > _HELD_TERMS:
                    yield from counted()
        yield from counted()

    schema = "lang string, source string, term string, uses long, documents long"
    parts = read.mapInArrow(count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("documents").alias("documents"))


def _share(uses: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(SCALE * (uses + 1) / (total + kept))``, exact for counts of any size."""
    uses, total, kept = (F.col(c) if isinstance(c, str) else c for c in (uses, total, kept))
    scaled = (uses + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", scaled, (total + kept).cast("decimal(19,0)"))
    return 1 + whole


def divergence(p: Column | str, q: Column | str) -> Column:
    """``floor((p - q) * (p - q) / q)``."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for arrays; shares are at most ``SCALE + 1``, so squares fit 64 bits."""
    return (p - q) * (p - q) // q


def slice_rows(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Divergences ``(a, b, value)`` of sources summed over the terms of one slice, in blocks.

    ``frame`` has ``(source, term, p)``: a row without a term for each source of the
    language, ``p`` being its baseline, and the postings of the slice's terms.
    """
    base = frame[frame["term"].isna()].sort_values("source", kind="stable")
    sources, z = base["source"].to_numpy(), base["p"].to_numpy(np.int64)
    used = frame[frame["term"].notna()]
    term, named = pd.factorize(used["term"])
    peer = pd.Index(sources).get_indexer(used["source"])
    order = np.lexsort((peer, term))
    term, peer = term[order], peer[order]
    p = used["p"].to_numpy(np.int64)[order]
    begins = np.searchsorted(term, np.arange(len(named) + 1))  # the postings of each term
    by_group = np.argsort(peer, kind="stable")
    rows = np.searchsorted(peer[by_group], np.arange(len(sources) + 1))  # and of each group

    # Distinct shares of each group with the number of its terms that have them.
    pairs = pd.DataFrame({"peer": peer, "p": p}).value_counts(sort=False).reset_index().sort_values(["peer", "p"])
    held_peer, held_p, held_n = (pairs[c].to_numpy(np.int64) for c in ("peer", "p", "count"))
    ends = np.searchsorted(held_peer, np.arange(len(sources) + 1))
    sizes = np.diff(rows)

    out: list[np.ndarray] = []
    for group in range(len(sources)):
        # As if no term were used by both: the group's own against baselines, peers' against the group's.
        acc = (len(named) - sizes[group] - sizes) * _divergence(z[group], z)
        for i in range(ends[group], ends[group + 1]):
            acc += held_n[i] * _divergence(held_p[i], z)
        if len(held_p):
            theirs = np.concatenate([[0], np.cumsum(held_n * _divergence(z[group], held_p))])
            acc += theirs[ends[1:]] - theirs[ends[:-1]]
        # Terms of the group, scattered through the index; a run of them at a time.
        own = by_group[rows[group] : rows[group + 1]]
        spread = begins[term[own] + 1] - begins[term[own]]
        cuts = np.searchsorted(np.cumsum(spread), np.arange(_SCATTERED, spread.sum() + _SCATTERED, _SCATTERED))
        for part in np.split(own, np.unique(cuts)[:-1] if len(cuts) else []):
            if not len(part):
                continue
            n = begins[term[part] + 1] - begins[term[part]]
            at = np.repeat(begins[term[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mine, their = np.repeat(p[part], n), p[at]
            other = z[peer[at]]
            both = _divergence(mine, their) - _divergence(mine, other)
            both += _divergence(z[group], other) - _divergence(z[group], their)
            np.add.at(acc, peer[at], both)
        out.append(acc)
        if (len(out) + 1) * len(sources) > _HELD_PAIRS or group + 1 == len(sources):
            done = sources[group + 1 - len(out) : group + 1]
            b = np.tile(sources, len(out))
            yield pd.DataFrame({"a": np.repeat(done, len(sources)), "b": b, "value": np.concatenate(out)})
            out = []


def divergence_audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS,
    slice_postings: int = SLICE_POSTINGS, work: Workspace | None = None,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group ``(lang, source)`` of ``docs``.

    Part ``pair``: for each other source of the language, the divergence of the group's
    word shares from that source's, over all terms that at least ``min_documents`` rows
    of the language use. Part ``term``: the terms a group uses more than its language
    does, with their divergence, up to rank ``term_ranks``. Values fall with the rank;
    ties go to the item that is smaller in UTF-8. All arithmetic is in whole numbers.

    A null text, language or source is the empty one. A language without a kept term has
    pairs of value 0, one of a single source none. Repeated rows count each, an empty
    table gives no rows, and other columns are not read. A task holds a slice of the
    index and one array over the sources of a language; the result has a row for each
    pair of sources of a language, as asked for.
    """
    work = work or Workspace(docs.sparkSession)
    used = work.save(group_terms(docs, text, lang, source), "used")
    per_term = used.filter(F.col("term").isNotNull()).groupBy("lang", "term")
    kept = per_term.agg(F.sum("documents").alias("documents"), F.sum("uses").alias("lang_uses"), F.count(F.lit(1)).alias("sources"))
    kept = work.save(kept.filter(F.col("documents") >= min_documents).drop("documents"), "kept")
    languages = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("lang_uses").alias("lang_total"), F.sum("sources").alias("postings")
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("postings") / slice_postings)).cast("int")
    languages = work.save(languages.withColumn("parts", parts).drop("postings"), "languages")
    indexed = used.filter(F.col("term").isNotNull()).join(kept.drop("sources"), ["lang", "term"])
    indexed = work.save(indexed.select("lang", "source", "term", "uses", "lang_uses"), "postings")
    totals = indexed.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    groups = used.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.join(languages, "lang", "left").fillna({"total": 0, "kept": 0, "lang_total": 0, "parts": 1})
    groups = work.save(groups, "groups")

    p = _share("uses", "total", "kept")
    shares = indexed.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", p.alias("p"), _share("lang_uses", "lang_total", "kept").alias("q"), "parts"
    )
    shares = work.save(shares, "shares")

    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part")
    postings = shares.select("lang", part, "source", "term", "p")
    used_languages = groups.filter(F.col("kept") > 0)
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    baseline = _share(F.lit(0).cast("long"), "total", "kept")
    bases = used_languages.select("lang", every_part, "source", F.lit(None).cast("string").alias("term"), baseline.alias("p"))
    index = postings.unionByName(bases)

    def rows(key: tuple[str, int], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in slice_rows(pd.concat(frames, ignore_index=True)):
            found.insert(0, "lang", key[0])
            yield found

    pairs = index.groupBy("lang", "part").applyInPandas(rows, "lang string, a string, b string, value long")
    # Languages without a kept term have no slice; their pairs are as many, of value 0.
    bare = groups.filter(F.col("kept") == 0).groupBy("lang").agg(F.collect_set("source").alias("peers"))
    bare = bare.select("lang", "peers", F.explode("peers").alias("a"))
    bare = bare.select("lang", "a", F.explode("peers").alias("b"), F.lit(0).cast("long").alias("value"))
    summed = pairs.filter("a <> b").unionByName(bare.filter("a <> b")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    words = shares.filter(F.col("p") > F.col("q"))
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    words = words.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= term_ranks)
    return ranked.unionByName(words)


def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all sources of ``documents``."""
    return divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": divergence_query}

ORACLES = {
    "op13_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT n, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_uses FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.lang_uses), 0) AS lang_n
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
uses AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(u.c), 0) AS n
  FROM groups g LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(u.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 1)) // (t.n + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.lang_uses + 1)) // (l.lang_n + l.v)::HUGEINT AS q
  FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang
  LEFT JOIN uses u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
used AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM used))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
