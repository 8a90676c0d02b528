"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import slices, table, text_bytes
from pointlake.workspace import Workspace

# A file of public_tokenizers; a vocabulary of another place is named by its path. Strings
# that are tokens by themselves are listed in the JSON file of the same name beside it.
VOCABULARY = "byte_bpe_50k.tiktoken"
# White space of the splitting pattern, and the longest run of it that its matcher is given:
# it looks ahead behind a run and overflows its stack on one of about a million characters.
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
_LONGEST_RUN = 100_000
# Lengths per bucket of the suffix sums; their totals, one row each, are summed in one task.
_BUCKET_LENGTHS = 1024


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a vocabulary adds as whole tokens, with their ids; none without a JSON file."""
    beside = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as described:
        listed = json.load(described).get("added_tokens", [])
    odd = [t["content"] for t in listed if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that take the blanks beside them are not supported: {odd}")
    return {t["content"]: t["id"] for t in listed}


@cache
def encoder(vocabulary: str):
    """``text -> ids`` for a rank file, once per process.

    Ids are those of the JSON file beside it: a string that it adds as a token is that
    token wherever it stands, the longest first; the text between is encoded by itself.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    added = added_tokens(path)
    whole = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def encode_plain(text: str) -> list[int]:
        if len(text) <= _LONGEST_RUN:
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUNS.finditer(text):
            if run.end() - run.start() > _LONGEST_RUN:
                # The pattern makes one piece of a run up to its last character, which may
                # begin the next piece; a run that ends the text is a piece as a whole.
                stop = run.end() - (run.end() < len(text))
                ids += encoding.encode_ordinary(text[at : run.start()])
                ids += encoding._encode_single_piece(text[run.start() : stop])
                at = stop
        return ids + encoding.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for token in whole.finditer(text):
            ids += encode_plain(text[at : token.start()])
            ids.append(added[token.group()])
            at = token.end()
        return ids + encode_plain(text[at:]) if ids else encode_plain(text)

    return encode


def decoded(batch: pa.RecordBatch, text: int) -> Iterator[list[str]]:
    """Texts of a column, some at a time; null is empty."""
    for part in slices(batch, text):
        yield [(v or b"").decode("utf-8", "replace") for v in text_bytes(part.column(text))]


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(length, documents)``: how many texts have each encoded length.

    Every text is encoded whole; a null or empty one has length 0. Repeated rows count
    each. An empty table gives no rows. Each task sums its own lengths, so a shuffle row
    is a length, never a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(vocabulary), Counter()
        for batch in batches:
            for texts in decoded(batch, 0):
                counts.update(len(encode(t)) for t in texts)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.int64()), pa.array(list(counts.values()), type=pa.int64())],
                names=["length", "documents"],
            )

    parts = docs.select(text).mapInArrow(run, "length long, documents long")
    return parts.groupBy("length").agg(F.sum("documents").alias("documents"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """Answers at every length of ``(length, documents)``, by suffix sums.

    ``documents_from`` and ``tokens_from`` count documents at least that long,
    ``truncated_tokens`` is the corpus' size when texts are cut to that length, and
    ``quantile`` the share of documents that fit it whole. Between two lengths of the
    histogram ``truncated_tokens`` grows by ``documents_from`` of the upper one for each
    token of the limit, so the rows answer every limit.

    Lengths are summed in buckets and the buckets among each other, so no task holds all.
    """
    cells = histogram.select(
        "length",
        "documents",
        (F.col("length") * F.col("documents")).alias("tokens"),
        F.floor(F.col("length") / _BUCKET_LENGTHS).alias("bucket"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("length"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("bucket").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    later = sums.select(
        "bucket",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
    )
    totals = sums.agg(F.sum("d").alias("all_documents"), F.sum("t").alias("all_tokens"))
    own = cells.select(
        "*", F.sum("documents").over(inside).alias("d_in"), F.sum("tokens").over(inside).alias("t_in")
    )
    # One row of totals, whatever the data.
    joined = own.join(later, "bucket").join(F.broadcast(totals))
    documents_from = F.col("d_in") + F.col("d")
    tokens_from = F.col("t_in") + F.col("t")
    return joined.select(
        "length",
        "documents",
        "tokens",
        documents_from.alias("documents_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + documents_from * F.col("length")).alias("truncated_tokens"),
        ((F.col("all_documents") - documents_from + F.col("documents")) / F.col("all_documents")).alias("quantile"),
    )


def quantiles(totals: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least ``share`` of the documents fit."""
    lengths = [
        F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("quantile") >= s, F.col("length"))).alias("length"))
        for s in shares
    ]
    return totals.agg(F.array(*lengths).alias("answers")).select(F.inline("answers"))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(limit, tokens, documents_cut)`` for any context limits, from the histogram alone."""
    answers = [
        F.struct(
            F.lit(int(limit)).alias("limit"),
            F.sum(F.least("length", F.lit(int(limit))) * F.col("documents")).alias("tokens"),
            F.sum(F.when(F.col("length") > limit, F.col("documents")).otherwise(0)).alias("documents_cut"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*answers).alias("answers")).select(F.inline("answers"))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents at every encoded length."""
    # Stored, as several sums read it and the texts should be encoded once.
    histogram = Workspace(spark).save(length_histogram(table(spark, sf_dir, "documents")), "lengths")
    return context_totals(histogram)


QUERIES = {"op7_token_counts": token_counts_query}
