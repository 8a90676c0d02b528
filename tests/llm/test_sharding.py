import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointlake.llm.sharding import communication_matrix, hypergeometric, shard_sizes, shuffle_into_shards
from tests.llm.conftest import make_docs


def _check(rows, shards, total):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == total
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_matrix_has_the_given_margins():
    parts, shards = [7, 0, 100, 3], shard_sizes(110, 16)
    matrix = list(communication_matrix(parts, shards, seed=3))
    assert [sum(r) for r in matrix] == parts
    assert [sum(c) for c in zip(*matrix, strict=True)] == shards


def test_hypergeometric_has_its_mean_and_spread():
    rng = random.Random(1)
    drawn = [hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    mean = sum(drawn) / len(drawn)
    assert mean == pytest.approx(6, abs=0.05)
    assert sum((x - mean) ** 2 for x in drawn) / len(drawn) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.05)
    assert 0 <= hypergeometric(rng, 10**11, 10**12, 10**10) <= 10**10


def test_sizes_slots_and_rows(spark):
    docs = spark.range(1003).withColumn("shard", F.lit("mine")).repartition(5)
    rows = shuffle_into_shards(docs, 16, seed=2, bucket_rows=20).collect()
    _check(rows, 16, 1003)
    assert sorted(r["id"] for r in rows) == list(range(1003))


def test_a_matrix_stored_in_parts_is_the_same(spark):
    docs = spark.range(500).repartition(7)
    whole = sorted(shuffle_into_shards(docs, 4, seed=2).collect())
    assert sorted(shuffle_into_shards(docs, 4, seed=2, plan_parts=2).collect()) == whole


def test_nulls_repeats_and_empty_tables(spark):
    docs = make_docs(spark, [(None, None), (1, "a"), (1, "a"), (1, "a"), (2, "")])
    rows = shuffle_into_shards(docs, 2).collect()
    _check(rows, 2, 5)
    assert Counter(r["text"] for r in rows) == {"a": 3, None: 1, "": 1}
    assert shuffle_into_shards(docs.limit(0), 4).count() == 0


def test_every_place_is_as_likely(spark):
    docs = spark.range(64).repartition(4)
    first = Counter()
    for seed in range(30):
        first.update(r["shard"] for r in shuffle_into_shards(docs, 4, seed).filter("id < 16").collect())
    assert all(abs(first[s] - 120) < 45 for s in range(4))


def test_the_main_path_has_no_python(spark):
    plan = shuffle_into_shards(spark.range(50))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
