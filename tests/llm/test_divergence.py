import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.llm.divergence import divergence_audit, slice_rows
from tests.llm.conftest import DOCS

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, ranks=200):
    """The audit of ``(text, lang, source)`` rows, in plain loops and whole numbers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    found = []
    for lang in {r[1] for r in rows}:
        documents, uses, whole = Counter(), defaultdict(Counter), Counter()
        for text, own, source in rows:
            if own == lang:
                words = WORD.findall(text.translate(LOWER))
                documents.update(set(words))
                uses[source].update(words)
                whole.update(words)
        kept = sorted(t for t, n in documents.items() if n >= 3)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p = {s: shares(c) for s, c in uses.items()}
        q = shares(whole)
        for s in uses:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in uses if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if uses[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", words, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(found)


def made(rng, n, words=40, sources=6):
    vocabulary = [rng.choice(["w", "É", "Straße", "x", "猫"]) + "abcdefghijklmnop"[i % 16] * (i // 16 + 1) for i in range(words)]
    return [
        (" ".join(rng.choices(vocabulary, weights=range(1, words + 1), k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{min(rng.randrange(sources * 2), sources)}")
        for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS)


def audit(spark, rows, **options):
    return sorted(tuple(r) for r in divergence_audit(frame(spark, rows), **options).collect())


@pytest.mark.parametrize("seed, postings", [(1, 250_000), (2, 20), (3, 1)])
def test_audit_equals_brute_force(spark, seed, postings):
    rows = made(random.Random(seed), 150)
    assert audit(spark, rows, slice_postings=postings) == brute_audit(rows)


def test_ranks_are_limited_for_terms_only(spark):
    rows = made(random.Random(4), 200)
    assert audit(spark, rows, term_ranks=2) == brute_audit(rows, ranks=2)


def test_edge_rows(spark):
    rows = [
        (None, None, None), ("", "en", "a"), ("one Two-three TWO", "en", "b"), ("two! ONE", "en", "c"), ("two", "en", None), ("one", None, "a"),
        ("lonely", "xx", "only"), ("no term kept", "yy", "p"), ("another", "yy", "q"), ("İ ß Éé É é", "en", "d"), ("é É", "en", "b"), ("É", "en", "b"),
        ("two " * 200_000, "en", "b"), ("one two", "en", "b"), ("one two", "en", "b"),
    ]
    assert audit(spark, rows) == brute_audit(rows)
    clash = frame(spark, rows).withColumn("term", F.lit("x")).withColumn("part", F.lit(1)).withColumn("p", F.lit(2)).repartition(4)
    assert sorted(tuple(r) for r in divergence_audit(clash).collect()) == brute_audit(rows)
    assert audit(spark, []) == []


def test_a_slice_in_small_blocks(monkeypatch):
    monkeypatch.setattr("pointlake.llm.divergence._HELD_PAIRS", 7)
    monkeypatch.setattr("pointlake.llm.divergence._SCATTERED", 3)
    z = {"a": 5, "b": 7, "c": 2, "d": 9}
    shares = {"a": {"x": 50, "y": 20}, "b": {"x": 70}, "c": {"y": 11, "z": 40}, "d": {}}
    rows = [(s, None, v) for s, v in z.items()] + [(s, t, v) for s, own in shares.items() for t, v in own.items()]
    blocks = list(slice_rows(pd.DataFrame(rows, columns=["source", "term", "p"])))
    assert len(blocks) == 4
    p = lambda s, t: shares[s].get(t, z[s])
    for r in pd.concat(blocks).itertuples():
        assert r.value == sum((p(r.a, t) - p(r.b, t)) ** 2 // p(r.b, t) for t in "xyz")
