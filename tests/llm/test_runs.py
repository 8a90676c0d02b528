import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm.runs import find_runs, periodic_runs, run_digests, runs_query, with_planted_runs
from tests.llm.conftest import SF, make_docs


def brute_runs(words, min_words=6, min_periods=4):
    n, found = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(min_words, min_periods * q):
                held = words[s : s + length]
                if not any(held[d:] == held[:-d] for d in range(1, q)):
                    found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(key, text):
    words = planted(key, (text or "").encode().split()) if key is not None else (text or "").encode().split()
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def wild_words(rng, n, letters):
    words = []
    while len(words) < n:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
        times = rng.choice([1, 1, 2, 3, 5, 7])
        words += (unit * times)[: rng.randint(1, len(unit) * times)]
    return words[:n]


@pytest.mark.parametrize("min_words, min_periods", [(6, 4), (6, 3), (15, 3), (2, 3), (20, 5)])
def test_runs_equal_brute_force(min_words, min_periods):
    rng = random.Random(min_words * 10 + min_periods)
    for _ in range(800):
        words = wild_words(rng, rng.randint(0, 90), "abcdef"[: rng.randint(1, 6)])
        found = find_runs(np.array(words, dtype=object), min_words, min_periods)
        assert [tuple(r) for r in found] == brute_runs(words, min_words, min_periods)


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        find_runs(np.array(["a"] * 9, dtype=object), 6, 2)


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = sorted(tuple(r) for r in runs_query(spark, SF).collect())
    assert found == sorted(expected(k, t) for k, t in docs.items())
    assert sum(r[1] > 0 for r in found) > 10


def test_edge_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "ä　ö " * 9, "A a " * 4 + "a"]
    texts += [" ".join(wild_words(rng, 300, "xyz")) for _ in range(40)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(None, "z " * 30), (3, "a " * 9), (3, "a " * 9)]
    docs = make_docs(spark, pairs).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)).repartition(3)
    found = run_digests(periodic_runs(with_planted_runs(docs))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found), key=key) == sorted((expected(k, t) for k, t in pairs), key=key)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(2)
    noise = " ".join(str(rng.randrange(50_000)) for _ in range(300_000))
    texts = ["w " * 400_000, " ".join(str(i % 1009) for i in range(300_000)), noise]
    rows = {r["doc_id"]: r for r in periodic_runs(make_docs(spark, texts)).collect()}
    assert [tuple(r) for r in rows[0]["runs"]] == [(0, 400_000, 1)] and bytes(rows[0]["collapsed"]) == b"w"
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 300_000, 1009)]
    assert rows[2]["runs"] == [] and bytes(rows[2]["collapsed"]).decode() == noise
