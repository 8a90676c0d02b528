import pytest
from pyspark.sql import functions as F

from pointlake.operators.aggregates import (
    compression_ratio,
    groups_with_size,
    nearest_to_mean,
    sum_of_squares,
    with_distance_to_mean,
)
from pointlake.operators.joins import enrich, remaining_items
from pointlake.operators.labels import contiguous_labels, relabel, shuffled_labels
from pointlake.operators.sampling import sample_per_group
from pointlake.operators.skew import skew_join


def _skewed(spark):
    key = F.when(F.col("id") % 10 < 5, 1).when(F.col("id") % 10 < 7, F.lit(None)).otherwise(F.col("id"))
    return spark.range(1000).select(key.cast("long").alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, how):
    left = _skewed(spark)
    right = spark.range(0, 1000, 3).select((F.col("id") + 1).alias("k"), F.col("id").alias("w"))
    right = right.unionByName(right.limit(10))
    plain = left.join(right, ["k"], how).select("k", "v", "w")
    for hot_rows in (5, 10_000):
        found = skew_join(left, right, ["k"], how, hot_rows=hot_rows, salts=8)
        assert found.columns == ["k", "v", "w"]
        assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


def test_skew_join_spreads_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left, right = _skewed(spark), spark.createDataFrame([(1, "a")], "k long, w string")
        joined = skew_join(left, right.repartition(2), ["k"], "left", hot_rows=100, salts=16)
        rows = joined.filter("k = 1").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 500
        assert "BroadcastNestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_enrich_renames_collisions(spark):
    left = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 4.0)], "id long, size double")
    right = spark.createDataFrame([(1, 9.0, 5)], "id long, size double, root long")
    for hot_rows in (None, 0, 100):
        rows = enrich(left, right, hot_rows=hot_rows).orderBy("size").collect()
        assert [tuple(r) for r in rows] == [(1, 2.0, 9.0, 5), (2, 3.0, None, None), (None, 4.0, None, None)]


def test_remaining_items(spark):
    expected = spark.range(1000).withColumnRenamed("id", "item")
    done = spark.range(800).select(F.col("id").alias("item")).unionByName(spark.range(800).select(F.lit(3).alias("item")))
    left = remaining_items(expected, done, ["item"])
    assert sorted(r["item"] for r in left.collect()) == list(range(800, 1000))


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 5, 1).otherwise(2).alias("g"))
    first = sample_per_group(rows, ["g"], 20, ["id"], seed=3)
    assert {r["g"]: r["count"] for r in first.groupBy("g").count().collect()} == {1: 5, 2: 20}
    assert first.exceptAll(sample_per_group(rows, ["g"], 20, ["id"], seed=3)).count() == 0
    assert first.exceptAll(sample_per_group(rows, ["g"], 20, ["id"], seed=4)).count() > 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("bucket", [7, 1 << 20])
def test_contiguous_labels(spark, bucket):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") * 5 % 91).alias("c"))
    found = contiguous_labels(rows, ["g"], "c", "label", bucket_keys=bucket).collect()
    for g in range(3):
        mine = sorted((r["c"], r["label"]) for r in found if r["g"] == g)
        assert [label for _, label in mine] == list(range(len(mine)))


def test_shuffled_labels_are_a_permutation(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") * 3).alias("label"))
    mapping = shuffled_labels(rows, ["g"], "label", seed=5, buckets=16)
    found = mapping.collect()
    for g in range(2):
        mine = [r for r in found if r["g"] == g]
        assert sorted(r["label"] for r in mine) == sorted(r["shuffled"] for r in mine)
        assert [r["label"] for r in mine] != [r["shuffled"] for r in mine]
    again = shuffled_labels(rows, ["g"], "label", seed=5, buckets=16)
    assert mapping.exceptAll(again).count() == 0
    renamed = relabel(rows, mapping, ["g"], "label", "shuffled", hot_rows=1)
    assert renamed.count() == 400


def test_aggregates(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert {r["g"]: r["len"] for r in groups_with_size(rows, ["g"], 33, 40).collect()} == {0: 34}
    assert sum_of_squares(rows, "id").first()[0] == sum(i * i for i in range(100))
    assert compression_ratio(rows, ["g"]).first()[0] == pytest.approx(0.03)
    for hot_rows in (1, 1000):
        far = with_distance_to_mean(rows, ["g"], ["x", "y"], "d", hot_rows=hot_rows)
        assert far.filter("id = 0").first()["d"] == pytest.approx(49.5)
        near = {r["g"]: r["id"] for r in nearest_to_mean(rows, ["g"], ["x", "y"], "id", hot_rows=hot_rows).collect()}
        # Group 0 has an even number of members: the smaller id wins the tie.
        assert near == {0: 48, 1: 49, 2: 50}


def test_relabel_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, 3), ("a", 4)], "g string, label long")
    mapping = shuffled_labels(rows, ["g"], "label", seed=1)
    found = relabel(rows, mapping, ["g"], "label", "shuffled").collect()
    assert sorted(str(r["label"]) for r in found) == ["1", "2", "3", "4", "None"]
    with pytest.raises(Exception, match="no shuffled for label 4"):
        relabel(rows, mapping.filter("label <> 4"), ["g"], "label", "shuffled").collect()


def test_far_apart_ids_are_numbered(spark):
    keys = [i * (2**62 // 500) - 2**61 for i in range(1000)]
    rows = spark.createDataFrame([("a" if i % 3 else None, k) for i, k in enumerate(keys)], "g string, key long")
    found = contiguous_labels(rows, ["g"], "key", "n").collect()
    for g in ("a", None):
        mine = sorted((r["key"], r["n"]) for r in found if r["g"] == g)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert len(found) == 1000
