"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal shingle sets form a class. Classes that share a band of MinHash values
are candidates. A candidate pair's values are compared some at a time; the pair is dropped
once the posterior probability that its similarity reaches the threshold is below a
tolerance, and verified exactly on the shingles otherwise. Pairs stay inside the task that
compares two blocks of classes; what leaves it is a row per class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.text import mix, slices, table, text_bytes, word_hashes, words
from pointlake.operators.components import smallest_reachable
from pointlake.operators.skew import skew_join
from pointlake.workspace import Workspace

SHINGLE = 5
THRESHOLD = 0.8
# A pair of similarity s shares a band but for a chance of (1 - s**ROWS) ** BANDS: 3e-6 at
# the threshold, 2e-8 at 0.85.
BANDS = 32
ROWS = 5
# Posterior probability below which a pair is given up.
TOLERANCE = 1e-7
COMPARE = 20  # MinHash values compared at a time
# Shingles and signatures that a block of classes holds, about; a task compares two blocks.
BLOCK_BYTES = 2_000_000
# A component of more blocks than this is compared band by band instead of as a whole.
MAX_BLOCKS = 16
# A key is spread over tasks if it has more rows than this and than two tasks' fair share.
FAIR_ROWS = 1000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SECOND = _rng.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_CHUNK = 1024  # shingles hashed at a time


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words; all of a shorter text's words are one."""
    h = word_hashes(words(text))
    n = max(len(h) - size + 1, min(len(h), 1))
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(h))):
        total = mix(total + h[i : i + n])
    return np.unique(total)


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles: the least of each of many permutations of 32 bits."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(short), _CHUNK):
        y = short[None, at : at + _CHUNK] * _FACTORS[:, None]
        y ^= y >> np.uint32(15)
        y *= _SECOND[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_hashes(sign: np.ndarray) -> np.ndarray:
    """One number per band of a signature; different bands have different numbers."""
    total = np.arange(BANDS, dtype=np.uint64) * np.uint64(2**32)
    for column in sign.reshape(BANDS, ROWS).T:
        total = mix(total + column)
    return total.view(np.int64)


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Matches a pair needs among the first 20, 40, ... values to be kept.

    With a uniform prior the similarity after ``m`` matches of ``n`` has the density
    Beta(m + 1, n - m + 1); it reaches ``t`` with the probability that a binomial of
    ``n + 1`` trials at ``t`` is at most ``m``.
    """
    needed = []
    for n in range(COMPARE, BANDS * ROWS + 1, COMPARE):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        needed.append(m)
    return needed


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text_key, fp, bands)`` of every document; a text without words has no ``fp``."""
    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                prints, bands = [], []
                for value in text_bytes(batch.column(2)):
                    found = shingles(value)
                    prints.append(fingerprint(found) if len(found) else None)
                    bands.append(band_hashes(signature(found)) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "fp", "bands"],
                )

    return read.mapInArrow(run, f"doc_id {kind}, text_key long, fp binary, bands array<long>")


def _spread_join(
    left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, rows: int, work: Workspace
) -> DataFrame:
    """``left.join(right, on)`` for one row a key in ``right``; keys with too many of the ``rows`` rows are spread.

    ``counts`` is stored and has the rows of each key of ``left`` as ``n``. No more keys
    are spread than half the shuffle partitions, which bounds what is broadcast.
    """
    partitions = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(FAIR_ROWS, 2 * rows // partitions)
    if rows <= fair:
        return skew_join(left, right, on, hot=False)
    hot = work.save(counts.filter(F.col("n") > fair).select(*on, F.col("n").alias("_n")), "hot")
    return skew_join(left, right, on, hot=False if hot.isEmpty() else hot, hot_rows=fair)


def connect(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(node, root)`` for every node of ``(node, root)`` edges; the root is the component's least node.

    Rounds of large and small stars: each node hands its larger neighbours, then its
    smaller ones, to the least of them. The number of rounds grows with the logarithm of
    the component, and each round only holds edges. The neighbours of a hub are spread
    over tasks. Rounds are stored, so a lost executor costs its tasks.
    """
    lowest = F.min("root").alias("low"), F.count(F.lit(1)).alias("n")
    stars = work.save(edges.filter("node <> root").distinct(), "edges")
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = now
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = work.save(both.groupBy("node").agg(*lowest), "least")
        to = least.select("node", F.least("node", "low").alias("low"))
        large = _spread_join(both.filter("root > node"), to, ["node"], least, 2 * now[0], work)
        large = large.select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = work.save(large.filter("node <> root").distinct(), "large")
        low = work.save(large.groupBy("node").agg(*lowest), "low")
        small = _spread_join(large, low.drop("n"), ["node"], low, large.count(), work)
        small = small.select(F.col("root").alias("node"), F.col("low").alias("root"))
        small = small.unionByName(low.select("node", F.col("low").alias("root")))
        stars = work.save(small.filter("node <> root").distinct(), "stars")


def _compare(left: list, right: list | None, kind: int, needed: list[int], threshold: float) -> Iterator[tuple[int, int]]:
    """Index pairs of similar classes, of ``left`` among each other or with ``right``.

    An entry is ``(fp, copies, signature, shingles)``. With a band as ``kind`` only pairs
    are judged that share no earlier band, so that no pair is judged twice.
    """
    others = left if right is None else right
    signs = np.stack([x[2] for x in others])
    sizes = np.array([len(x[3]) for x in others])
    for a, (_, _, sign, own) in enumerate(left):
        first = a + 1 if right is None else 0
        if first >= len(others):
            break
        bands = (signs[first:].reshape(-1, BANDS, ROWS) == sign.reshape(BANDS, ROWS)).all(axis=2)
        chosen = bands.any(axis=1) if kind < 0 else bands[:, kind] & ~bands[:, :kind].any(axis=1)
        # No set this much larger or smaller can reach the threshold.
        fits = np.minimum(sizes[first:], len(own)) >= threshold * np.maximum(sizes[first:], len(own)) - 1e-9
        at = first + np.flatnonzero(chosen & fits)
        matches = np.zeros(len(at), dtype=np.int64)
        for step, least in enumerate(needed):
            part = slice(step * COMPARE, (step + 1) * COMPARE)
            matches += (signs[at, part] == sign[part]).sum(axis=1)
            kept = matches >= least
            at, matches = at[kept], matches[kept]
        if not len(at):
            continue
        flat = np.concatenate([others[b][3] for b in at])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        ends = np.cumsum(sizes[at])
        common = np.add.reduceat((own[place] == flat).astype(np.int64), ends - sizes[at])
        similar = common >= threshold * (sizes[at] + len(own) - common) - 1e-9
        yield from ((a, int(b)) for b in at[similar])


def _compare_blocks(frame: pd.DataFrame, needed: list[int], threshold: float) -> pd.DataFrame:
    """Links found in one pair of blocks: a row for each class that has any."""
    first = frame.iloc[0]
    frame = frame.sort_values("fp")
    entries = [
        (bytes(r.fp), int(r.copies), np.frombuffer(r.sign, np.uint32), np.frombuffer(r.shingles, np.uint64))
        for r in frame.itertuples()
    ]
    block = frame["block"].to_numpy()
    if first["i"] == first["j"]:
        number, other, left, right = np.arange(len(entries)), np.arange(len(entries)), entries, None
    else:
        number, other = np.flatnonzero(block == first["i"]), np.flatnonzero(block == first["j"])
        left, right = [entries[n] for n in number], [entries[n] for n in other]
    pairs = list(_compare(left, right, int(first["kind"]), needed, threshold)) if len(left) and (right is None or right) else []
    if not pairs:
        return pd.DataFrame({"fp": [], "docs": [], "classes": [], "root": []})
    a, b = number[[p[0] for p in pairs]], other[[p[1] for p in pairs]]
    copies = np.array([e[1] for e in entries])
    docs = np.zeros(len(entries), dtype=np.int64)
    np.add.at(docs, a, copies[b])
    np.add.at(docs, b, copies[a])
    classes = np.bincount(a, minlength=len(entries)) + np.bincount(b, minlength=len(entries))
    root = smallest_reachable(len(entries), a, b)
    linked = np.flatnonzero(classes)
    return pd.DataFrame(
        {
            "fp": [entries[n][0] for n in linked],
            "docs": docs[linked],
            "classes": classes[linked],
            "root": [entries[root[n]][0] for n in linked],
        }
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    work: Workspace | None = None,
    block_bytes: int = BLOCK_BYTES,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """A row per document: its class, its links, and a key of its text.

    ``class_id`` is the least id among the documents that are linked to it, directly or
    by others, ``copy_id`` the least among those with the same shingles, ``n_links`` how
    many documents have similar or equal shingles, and ``n_class_links`` how many other
    shingle sets are similar. ``text_key`` tells rows with one id apart.

    A text of fewer than five words is one shingle. A null text or one without words has
    links to none and its own id as class. A class whose ids are all null has a null id.
    Repeated rows are documents each, with one id. An empty table gives no rows.

    Classes that share a band are connected first. A component is compared as a whole in
    pairs of blocks; one of more than ``max_blocks`` blocks is compared within each band,
    so chains of accidental candidates are not multiplied out. Either way every candidate
    pair is judged, once. Copies weigh in by their number and never form pairs.
    """
    return _grouped(docs, key, text, threshold, tolerance, work, block_bytes, max_blocks).drop("root")


def _grouped(
    docs: DataFrame, key: str, text: str, threshold: float, tolerance: float, work: Workspace | None, block_bytes: int, max_blocks: int
) -> DataFrame:
    """Rows of :func:`near_duplicates` with ``root``, the same in a group of linked classes; null without words."""
    work = work or Workspace(docs.sparkSession)
    described = work.save(describe(docs, key, text), "described")
    classes = work.save(
        described.filter("fp IS NOT NULL")
        .groupBy("fp")
        .agg(
            # The first document of the class; one without an id comes last.
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("bands").alias("bands"),
        )
        .select("fp", F.col("first.doc_id").alias("copy_id"), F.col("first.text_key").alias("text_key"), "copies", "bands"),
        "classes",
    )
    bands = classes.select("fp", F.explode("bands").alias("band"))
    held = F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n")
    shared = work.save(bands.groupBy("band").agg(*held).filter("low <> high").drop("high"), "shared")
    candidates = _spread_join(bands, shared.drop("n"), ["band"], shared, BANDS * classes.count(), work)
    candidates = candidates.select(F.col("fp").alias("node"), F.col("low").alias("root"))
    components = connect(candidates, work)

    asked = classes.drop("bands").join(components.withColumnRenamed("node", "fp"), "fp")
    members = work.save(_with_shingles(docs, asked, key, text), "members")
    found = work.save(_links(members, threshold, tolerance, block_bytes, max_blocks, work), "links")
    links = found.groupBy("fp").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("n_class_links"))
    groups = connect(found.select(F.col("fp").alias("node"), "root"), work).withColumnRenamed("node", "fp")
    named = classes.select("fp", "copy_id", "copies").join(groups, "fp", "left").join(links, "fp", "left")
    # A class without links is its own group, so that no missing root gathers them.
    named = work.save(named.withColumn("root", F.coalesce("root", "fp")), "named")
    least = work.save(named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "groups")
    known = _spread_join(named, least.drop("n"), ["root"], least, named.count(), work).select(
        "fp",
        "root",
        "class_id",
        "copy_id",
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"),
    )
    repeats = classes.select("fp", F.col("copies").alias("n"))
    worded = described.filter("fp IS NOT NULL").select("doc_id", "text_key", "fp")
    linked = _spread_join(worded, known, ["fp"], repeats, described.count(), work)
    wordless = described.filter("fp IS NULL").select(
        "doc_id",
        "text_key",
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_class_links"),
        F.lit(None).cast("binary").alias("root"),
    )
    return linked.select(*wordless.columns).unionByName(wordless)


def _with_shingles(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """``asked`` classes, a row each, with the signature and shingles of their first document."""
    texts = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).cast("binary").alias("_text"))
    same = texts["_id"].eqNullSafe(asked["copy_id"]) & (texts["_key"] == asked["text_key"])
    # Rows repeated with that id and text are dropped in the task that joins them.
    joined = texts.join(asked, same).groupBy("fp").agg(*(F.first(c).alias(c) for c in ("copies", "root", "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                found = [shingles(v) for v in text_bytes(batch.column(3))]
                own = [len(x) > 0 and fingerprint(x) == fp for x, fp in zip(found, batch.column(0).to_pylist(), strict=True)]
                kept = [x for x, is_own in zip(found, own, strict=True) if is_own]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).filter(pa.array(own, pa.bool_())) for i in range(3)),
                        pa.array([signature(x).tobytes() for x in kept], pa.binary()),
                        pa.array([x.tobytes() for x in kept], pa.binary()),
                    ],
                    names=["fp", "copies", "root", "sign", "shingles"],
                )

    return joined.mapInArrow(run, "fp binary, copies long, root binary, sign binary, shingles binary")


def _links(
    members: DataFrame, threshold: float, tolerance: float, block_bytes: int, max_blocks: int, work: Workspace
) -> DataFrame:
    """``(fp, docs, classes, root)`` per class and pair of blocks in which it has a link."""
    weight = F.octet_length("shingles") + F.octet_length("sign")
    blocks = F.ceil(F.sum(weight) / block_bytes).cast("int").alias("blocks")
    sizes = work.save(members.groupBy("root").agg(blocks, F.count(F.lit(1)).alias("n")), "sizes")
    sized = _spread_join(members, sizes.drop("n"), ["root"], sizes, members.count(), work)
    whole = sized.filter(F.col("blocks") <= max_blocks).withColumn("kind", F.lit(-1)).withColumnRenamed("root", "part")
    crowded = sized.filter(F.col("blocks") > max_blocks).drop("blocks", "root")
    values = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sign", b * (4 * ROWS) + 1, F.lit(4 * ROWS))
    )
    banded = crowded.select("*", F.posexplode(values).alias("kind", "part"))
    per_band = banded.join(banded.groupBy("kind", "part").agg(blocks), ["kind", "part"])
    keyed = whole.select(*per_band.columns).unionByName(per_band)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = keyed.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = met.select(
        "kind", "part", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        "block", "fp", "copies", "sign", "shingles",
    )
    needed = least_matches(threshold, tolerance)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _compare_blocks(frame, needed, threshold)

    return paired.groupBy("kind", "part", "i", "j").applyInPandas(compare, "fp binary, docs long, classes long, root binary")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that are linked to a document of a smaller id.

    One document of each class stays, the one of the least id, with its own columns; rows
    repeated with that id and text stay with it. A row without an id is never removed.
    """
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    found = near_duplicates(docs, **options)
    gone = found.filter("class_id <> doc_id").select("doc_id", "text_key").distinct()
    same = docs[key].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs[text]) == gone["text_key"])
    return docs.join(gone, same, "left_anti")


def keep_one(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    work: Workspace | None = None,
    block_bytes: int = BLOCK_BYTES,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``docs`` with exactly one row of each group of near duplicates, and every row without words.

    The row of the least id stays, one without an id last; of texts under one id the one of
    the least hash, and any of the rows that repeat that id and text.
    """
    work = work or Workspace(docs.sparkSession)
    found = _grouped(docs, key, text, threshold, tolerance, work, block_bytes, max_blocks).filter("root IS NOT NULL")
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = work.save(rows.withColumn("unnamed", F.col("doc_id").isNull()), "rows")
    place = F.struct("unnamed", "doc_id", "text_key")
    firsts = work.save(rows.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", "text_key", "n")).alias("first")), "firsts")
    is_first = place.eqNullSafe(F.struct("first.unnamed", "first.doc_id", "first.text_key"))
    gone = rows.join(firsts, "root").filter(~is_first).select("doc_id", "text_key")
    repeated = work.save(
        firsts.filter("first.n > 1").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")),
        "repeated",
    )

    def same(other: DataFrame):
        return docs[key].eqNullSafe(other["doc_id"]) & (F.xxhash64(docs[text]) == other["text_key"])

    if repeated.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    taken = gone.unionByName(repeated)
    again = docs.join(repeated, same(repeated), "left_semi")
    one = again.groupBy(F.col(key), F.xxhash64(text)).agg(F.first(F.struct(*again.columns)).alias("row")).select("row.*")
    return docs.join(taken, same(taken), "left_anti").unionByName(one)


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op3_jaccard": near_query}
