"""Toxicity by a classifier chain of sparse linear models, trained here in numpy.

Categories are predicted one after the other. Each model sees the words of the text, what
they begin with, and the probabilities of the earlier categories; those it is trained with
are out-of-fold, so that they look as they will for texts that no model has seen. The
penalty that chooses the words is the one of least out-of-fold loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.text import map_batches, slices, table, text_bytes, word_hashes, words

# Labelled documents the chain is fitted on, at most, chosen by a hash of their id.
TRAIN_ROWS = 12_000
FOLDS = 3
# Words also count by their first bytes, as many languages inflect a word at its end.
STEMS = (4, 6, 8)
# Words and stems a model may use: those whose presence departs most from independence of the label.
MAX_WORDS = 2_000
MIN_DOCUMENTS = 3  # documents of the sample that a usable word or stem occurs in
# Texts without a telling word stay near the share of wrong labels, far below this.
THRESHOLD = 0.4
# Penalties tried, from the one that keeps the fewest words on.
PENALTIES = (1e-3, 2.5e-4, 1.2e-4)
_L2 = 1e-4
_STEPS = 600
_STILL = 1e-4  # weights that change by less than this part of the largest have converged

N_SHAPE = 5
CATEGORIES = ("low_quality", "toxic")


@dataclass
class Model:
    """Logistic model: sorted hashes of words and stems with weights, and weights of the other inputs."""

    hashes: np.ndarray
    weights: np.ndarray
    other: np.ndarray  # shape of the text, earlier categories, constant


@dataclass
class Chain:
    names: list[str]
    models: list[Model]


def shape(text: bytes, tokens: list[bytes], distinct: int) -> list[float]:
    """What kind of text this is, each number between 0 and 1."""
    n = max(len(text), 1)
    raw = np.frombuffer(text, dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    symbols = n - upper - digits - int(((raw >= 97) & (raw <= 122) | (raw >= 128) | (raw == 32)).sum())
    return [
        min(np.log1p(len(tokens)) / 10, 1.0),
        distinct / max(len(tokens), 1),
        upper / n,
        digits / n,
        max(symbols, 0) / n,
    ]


def text_features(text: bytes | None) -> tuple[np.ndarray, list[float]]:
    """32-bit hashes of the distinct words and stems of a whole text, and its shape."""
    tokens = words(text)
    distinct = set(tokens)
    # No word holds a blank, so a stem is told from a word.
    stems = {w[:n] + b" " for n in STEMS for w in distinct if len(w) > n}
    hashes = (word_hashes([*distinct, *stems]) >> np.uint64(32)).astype(np.uint32)
    return np.unique(hashes), shape(text or b"", tokens, len(distinct))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 10


class Sample:
    """Labelled texts as rows of numbered words; only words of enough texts have a number."""

    def __init__(self, bags: list[np.ndarray]):
        flat = np.concatenate([*bags, np.zeros(0, np.uint32)])
        row = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
        # Texts a word may occur in at most, by coarse buckets; most rare words end here.
        coarse = np.bincount(flat & np.uint32((1 << 22) - 1), minlength=1 << 22)
        use = coarse[flat & np.uint32((1 << 22) - 1)] >= MIN_DOCUMENTS
        flat, row = flat[use], row[use]
        hashes, column, total = np.unique(flat, return_inverse=True, return_counts=True)
        use = total[column] >= MIN_DOCUMENTS
        number = np.cumsum(total >= MIN_DOCUMENTS) - 1
        self.hashes = hashes[total >= MIN_DOCUMENTS]
        self.row, self.column = row[use], number[column[use]].astype(np.int32)
        self.size = len(bags)

    def fit(self, other: np.ndarray, labels: np.ndarray, penalties: Sequence[float], rows: np.ndarray | None = None) -> list[Model]:
        """A logistic regression for each penalty on the words, fitted on some of the rows.

        The words that depart most from independence of the label take part. Accelerated
        proximal steps start from the solution of the penalty before.
        """
        inside = np.ones(self.size, bool) if rows is None else rows
        place = np.cumsum(inside) - 1
        use = inside[self.row]
        row, column = place[self.row[use]], self.column[use]
        other, labels = other[inside], labels[inside]
        n, share = len(labels), labels.mean()
        total = np.bincount(column, minlength=len(self.hashes))
        positive = np.bincount(column, weights=labels[row], minlength=len(self.hashes))
        expected = total * share
        departure = np.abs(positive - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
        departure[total < MIN_DOCUMENTS] = -1
        kept = np.sort(np.argsort(-departure, kind="stable")[:MAX_WORDS])
        kept = kept[departure[kept] >= 0]
        number = np.full(len(self.hashes), -1)
        number[kept] = np.arange(len(kept))
        use = number[column] >= 0
        row, column, d = row[use], number[column[use]], len(kept)

        def descend(w: np.ndarray, l1: float, l2: float) -> np.ndarray:
            """Weights of the words in use, then of the other inputs; the last one is never shrunk."""

            def times(w: np.ndarray) -> np.ndarray:
                return np.bincount(row, weights=w[:d][column], minlength=n) + other @ w[d:]

            def back(r: np.ndarray) -> np.ndarray:
                return np.concatenate([np.bincount(column, weights=r[row], minlength=d), r @ other])

            v = np.ones(d + other.shape[1])
            for _ in range(15):
                v = back(times(v))
                norm = np.linalg.norm(v)
                v /= norm
            rate = 4 * n / norm
            ahead, momentum = w, 1.0
            for _ in range(_STEPS):
                slope = back(_sigmoid(times(ahead)) - labels) / n
                slope[:-1] += l2 * ahead[:-1]
                step = ahead - rate * slope
                step[:-1] = np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * l1, 0)
                following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
                ahead = step + (momentum - 1) / following * (step - w)
                still = np.abs(step - w).max() <= _STILL * max(np.abs(step).max(), 1e-3)
                w, momentum = step, following
                if still:
                    break
            return w

        models, path, entries = [], np.zeros(d + other.shape[1]), (row, column)
        for l1 in penalties:
            row, column, d = *entries, len(kept)
            path = descend(path, l1, 0.0)
            # The penalty chose the words and shrank their weights; these are fitted again without it.
            chosen = np.flatnonzero(path[:d])
            renumber = np.full(d, -1)
            renumber[chosen] = np.arange(len(chosen))
            use = renumber[column] >= 0
            row, column, d = row[use], renumber[column[use]], len(chosen)
            w = descend(np.concatenate([path[chosen], path[len(kept) :]]), 0.0, _L2)
            models.append(Model(self.hashes[kept[chosen]], w[:d], w[d:]))
        return models


def _loss(p: np.ndarray, labels: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())


def fit_category(
    sample: Sample, bags: list[np.ndarray], other: np.ndarray, labels: np.ndarray, fold: np.ndarray, penalties: Sequence[float] = PENALTIES
) -> tuple[Model, np.ndarray]:
    """The model of the penalty with the least out-of-fold loss, and its out-of-fold probabilities.

    Ties go to the stronger penalty. Without two folds that have rows there is no
    out-of-fold prediction: the share of the label stands for it and the middle penalty is used.
    """
    outside = np.full((len(penalties), len(labels)), labels.mean())
    parts = np.unique(fold)
    if len(parts) < 2:
        return sample.fit(other, labels, penalties)[len(penalties) // 2], outside[0]
    for part in parts:
        test = np.flatnonzero(fold == part)
        for i, model in enumerate(sample.fit(other, labels, penalties, fold != part)):
            outside[i, test] = apply_model(model, [bags[j] for j in test], other[test])
    best = int(np.argmin([_loss(p, labels) for p in outside]))
    return sample.fit(other, labels, penalties[: best + 1])[best], outside[best]


def apply_model(model: Model, bags: list[np.ndarray], other: np.ndarray) -> np.ndarray:
    flat = np.concatenate([*bags, np.zeros(0, np.uint32)])
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    score = other @ model.other
    if len(model.hashes) and len(flat):
        at = np.minimum(np.searchsorted(model.hashes, flat), len(model.hashes) - 1)
        hit = model.hashes[at] == flat
        score = score + np.bincount(row[hit], weights=model.weights[at[hit]], minlength=len(bags))
    return _sigmoid(score)


def _inputs(shapes: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([shapes, *map(_logit, earlier), np.ones(len(shapes))])


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column],
    key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, folds: int = FOLDS, seed: int = 0,
) -> Chain | None:
    """A chain for ``categories``, conditions on ``labels`` in the order of prediction.

    ``labels`` has the column ``key``; rows with a null key or a null condition are left
    out. At most ``rows`` labelled documents are used, chosen by a hash of the key; their
    whole texts are read, and the hashes of their distinct words reach the driver. Returns
    ``None`` without a labelled document.
    """
    names = list(categories)
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    flags = labels.select(
        F.col(key).alias("_key"), hashed.alias("_order"), *[c.cast("int").alias(f"_c{i}") for i, c in enumerate(categories.values())]
    ).dropna()
    # Labels of documents that are not there use up none of the rows.
    flags = flags.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi")
    # Not more than ``rows`` rows of numbers: the bound of what is broadcast.
    chosen = flags.orderBy("_order", *[c for c in flags.columns if c != "_order"]).limit(rows)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_key").select("_text", "_order", *[f"_c{i}" for i in range(len(names))])
    schema = "words binary, shape array<double>, ord long, flags array<int>"

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_features(t) for t in text_bytes(batch.column(0))]
        flag_rows = list(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w.tobytes() for w, _ in found], pa.binary()),
                pa.array([s for _, s in found], pa.list_(pa.float64())),
                batch.column(1),
                pa.array(flag_rows, pa.list_(pa.int32())),
            ],
            names=["words", "shape", "ord", "flags"],
        )

    # Repeated documents could exceed the bound, so it holds for the joined rows as well.
    sample = map_batches(joined, schema, featurise).orderBy("ord", "words").limit(rows).collect()
    if not sample:
        return None
    # Texts with the same words count once: many copies of one text are no more evidence.
    once = {(bytes(r["words"]), *r["flags"]): (r["shape"], r["ord"]) for r in sample}
    del sample
    bags = [np.frombuffer(w, dtype=np.uint32) for w, *_ in once]
    truth = np.array([flags for _, *flags in once], dtype=np.float64)
    shapes = np.array([s for s, _ in once.values()], dtype=np.float64)
    fold = np.array([o for _, o in once.values()]) % folds
    del once  # the arrays hold what is needed
    numbered = Sample(bags)
    earlier: list[np.ndarray] = []
    models = []
    for i in range(len(names)):
        model, outside = fit_category(numbered, bags, _inputs(shapes, earlier), truth[:, i], fold)
        models.append(model)
        earlier.append(outside)
    return Chain(names, models)


def predict(chain: Chain, texts: list[bytes | None]) -> np.ndarray:
    """Probability of each category (columns) for each text (rows); NaN for a text without a word."""
    found = [text_features(t) for t in texts]
    bags, shapes = [w for w, _ in found], np.array([s for _, s in found]).reshape(-1, N_SHAPE)
    earlier: list[np.ndarray] = []
    for model in chain.models:
        earlier.append(apply_model(model, bags, _inputs(shapes, earlier)))
    p = np.column_stack(earlier)
    p[[len(bag) == 0 for bag in bags]] = np.nan
    return p


def score_toxicity(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text",
                   names: Sequence[str] = CATEGORIES) -> DataFrame:
    """``key`` and a column ``p_<category>`` for each category, one row per document.

    All words of the whole text count; repeated rows are scored alike. A text without a
    word, null and empty ones among them, has nothing to judge: its probabilities are null.
    So are those of ``names`` without a chain, as there was no labelled document.
    """
    if chain is None:
        return docs.select(key, *[F.lit(None).cast("double").alias(f"p_{n}") for n in names])
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [key, *(f"p_{n}" for n in chain.names)]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                p = predict(shared.value, text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, from_pandas=True) for c in p.T)], names=names)

    return docs.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, chain: Chain | None, category: str = "toxic", text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose ``category`` is not ``threshold`` or more, all columns as they are."""
    if chain is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at, which = docs.columns.index(text), chain.names.index(category)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = [predict(shared.value, text_bytes(part.column(at)))[:, which] for part in slices(batch, at)]
        return batch.filter(pa.array(~(np.concatenate(p) >= threshold)))

    return map_batches(docs, docs.schema, keep)


def label_chain(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """The chain for the given labels: low quality first, toxicity with its probability."""
    conditions = [F.col("quality") == 0, F.col("toxic") == 1]
    return fit_chain(docs, labels, dict(zip(CATEGORIES, conditions, strict=True)))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every document, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = label_chain(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain).withColumn("toxic", F.coalesce(F.col("p_toxic") >= THRESHOLD, F.lit(False)))


QUERIES = {"op9_toxicity": toxicity_query}
