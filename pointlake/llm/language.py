"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide
over a window's bytes, each filter keeps its largest response (max pooling), and a softmax
layer gives the window's language; a text has the mean of its windows' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.text import map_batches, slices, table, text_bytes

WIDTHS = (2, 3, 4)
FILTERS = 16  # per width
WINDOW = 256
# Labelled windows the network is fitted on, over all languages; one window per document.
TRAIN_ROWS = 6000
STEPS = 600  # batches the network is fitted on, whatever the number of windows
UNDETERMINED = "und"
# How far above chance the likeliest language of a text has to be for the pipeline to keep it:
# this part of the way that four languages leave. A short text has little to tell, and stays.
MARGIN = 0.04
_BATCH = 128
_CHUNK = 2048  # windows scored at a time


@dataclass
class Network:
    """``tables[w][i, byte]`` is what byte ``byte`` at place ``i`` adds to the filters of a width."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Filter responses ``(window, position, filter)``; two bytes are looked up at once."""
        pairs = self._pairs(width)
        code = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        positions = windows.shape[1] - width + 1
        total = pairs[0][code[:, :positions]]
        for i in range(1, width // 2):
            total += pairs[i][code[:, 2 * i : 2 * i + positions]]
        if width % 2:
            total += self.tables[width][-1][windows[:, width - 1 :]]
        return total

    def _pairs(self, width: int) -> list[np.ndarray]:
        cached = self.__dict__.setdefault("_pair_tables", {})
        if width not in cached:
            t = self.tables[width]
            cached[width] = [
                (t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, width - 1, 2)
            ]
        return cached[width]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair_tables"}

    def features(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.responses(windows, w).max(axis=1) for w in self.tables]
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.features(windows) @ self.dense + self.bias)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_windows(texts: Sequence[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the text each belongs to; the last is filled with zeros."""
    counts = np.array([-(-len(t) // size) for t in texts], dtype=np.int64)
    padded = b"".join(t + bytes(-len(t) % size) for t in texts)
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, size), np.repeat(np.arange(len(texts)), counts)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0, steps: int = STEPS) -> Network:
    """Fit the network by Adam; languages weigh alike however many windows they have."""
    rng = np.random.default_rng(seed)
    tables = {w: rng.normal(0, 0.3, size=(w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages, tables, rng.normal(0, 0.1, size=(total, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    counts = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / (len(languages) * np.maximum(counts, 1))).astype(np.float32)
    moments: dict = {}
    step = 0
    while step < steps:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), _BATCH):
            rows = order[at : at + _BATCH]
            x, y = windows[rows], labels[rows]
            # Some windows are cut short, so that short texts look familiar.
            cut = rng.integers(8, x.shape[1] * 3, size=len(x))
            x = np.where(np.arange(x.shape[1])[None, :] < cut[:, None], x, 0).astype(np.uint8)
            net.__dict__.pop("_pair_tables", None)
            places, pooled = [], []
            for w in WIDTHS:
                parts = [tables[w][i][x[:, i : x.shape[1] - w + 1 + i]] for i in range(w)]
                response = sum(parts[1:], parts[0])
                place = response.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ net.dense + net.bias)
            error[np.arange(len(y)), y] -= 1
            error *= (weight[y] / len(y))[:, None]
            back = (error @ net.dense.T) * (raw > 0)
            gradients = {"dense": hidden.T @ error, "bias": error.sum(axis=0)}
            for n, w in enumerate(WIDTHS):
                g = np.zeros_like(tables[w])
                part = back[:, n * FILTERS : (n + 1) * FILTERS]
                for i in range(w):
                    byte = np.take_along_axis(x, places[n] + i, axis=1)
                    np.add.at(g[i], (byte, np.arange(FILTERS)[None, :]), part)
                gradients[w] = g
            step += 1
            for name, g in gradients.items():
                value = getattr(net, name) if isinstance(name, str) else tables[name]
                m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.__dict__.pop("_pair_tables", None)
    return net


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    rows: int = TRAIN_ROWS, window: int = WINDOW, seed: int = 0,
) -> Network | None:
    """A network for the languages of ``lang``, or ``None`` without a labelled text.

    It is fitted on at most ``rows`` windows: labelled documents are chosen by a hash of
    ``key``, about as many of each language, and each gives a window from a place in its
    text that the hash chooses. Only these windows reach the driver.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    labelled = docs.filter(F.col(lang).isNotNull() & has_letter(text))
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return None
    share = rows / len(counts)
    chosen = F.pmod(hashed, F.lit(1_000_003)) / 1_000_003.0
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col(lang) == language, F.lit(min(1.0, share / n))).otherwise(rate)
    data = F.col(text).cast("binary")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.greatest(F.octet_length(text) - window, F.lit(0)) + 1)
    sample = (
        labelled.filter(chosen < rate)
        .select(F.substring(data, start.cast("int") + 1, F.lit(window)).alias("piece"), F.col(lang).alias("lang"),
                hashed.alias("order"), F.col(key).alias("key"))
        .orderBy("order", "key", "lang", "piece")
        .limit(rows)
        .collect()
    )
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    windows, _ = to_windows([bytes(r["piece"]) for r in sample], window)
    return train(windows, np.array([languages.index(r["lang"]) for r in sample]), languages, seed)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _classify(net: Network | None, texts: list[bytes | None], letters: list[bool]) -> tuple[list[str], np.ndarray]:
    """Language and its probability of each text; windows of many texts are scored together."""
    languages, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, x in enumerate(letters) if x]
    if net is None or not known:
        return languages, scores
    windows, owner = to_windows([texts[i] for i in known])
    total = np.zeros((len(known), len(net.languages)))
    for at in range(0, len(windows), _CHUNK):
        p = net.probabilities(windows[at : at + _CHUNK])
        np.add.at(total, owner[at : at + _CHUNK], p)
    total /= np.bincount(owner, minlength=len(known))[:, None]
    best = total.argmax(axis=1)
    for n, i in enumerate(known):
        languages[i], scores[i] = net.languages[best[n]], min(1.0, total[n, best[n]])
    return languages, scores


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``, one row per document.

    Every window of every text is classified. A text that is null or has no letter is
    ``und`` with score 0, as is every text without a network. Repeated rows are judged
    alike, and windows are scored a chunk at a time, however many a text has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string", "score double"])
    names = [*kept.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(names) - 2):
                *own, value, letters = batch.columns
                languages, scores = _classify(shared.value, text_bytes(value), letters.to_pylist())
                yield pa.RecordBatch.from_arrays([*own, pa.array(languages, pa.string()), pa.array(scores)], names=names)

    read = docs.select(*keep, F.col(text).cast("binary").alias("_text"), has_letter(text).alias("_letter"))
    return read.mapInArrow(run, schema)


def least_score(languages: int, margin: float = MARGIN) -> float:
    """The score from which a text counts as one of ``languages``: chance, and ``margin`` of what is above it.

    A text that looks like all languages scores 1 / ``languages``, however many these are:
    the bound is 0.28 for four, 0.54 for two and 0.114 for ten. A single language is
    always kept, as there is nothing to tell it from.
    """
    chance = 1 / max(languages, 1)
    return chance + 4 * margin * chance * (1 - chance)


def keep_identified(docs: DataFrame, net: Network | None, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Documents that ``least_score`` counts as one of the learned languages, all columns as they are."""
    min_score = least_score(len(net.languages) if net else 0, margin)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask: list[bool] = []
        for part in slices(batch, at):
            values = text_bytes(part.column(at))
            letters = [v is not None and any(c.isalpha() for c in v.decode("utf-8", "replace")) for v in values]
            languages, scores = _classify(shared.value, values, letters)
            mask += [lang != UNDETERMINED and s >= min_score for lang, s in zip(languages, scores, strict=True)]
        return batch.filter(pa.array(mask, pa.bool_()))

    return map_batches(docs, docs.schema, keep)


def held_out() -> Column:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return F.coalesce(remainder == 1, F.lit(False))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    net = fit(docs.filter(~F.col("held_out")))
    return identify(docs, net, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language": language_query}
