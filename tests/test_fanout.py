import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pointlake.operators import fanout
from pointlake.operators.fanout import check_outcome, failures, process_items, process_missing
from pointlake.sources.items import range_items

# Executors cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def square(item):
    return item * item


def named(item, table=None):
    return table[item]


def flaky(item):
    if item in (2, 5, 8):
        raise ValueError(f"cannot do {item}")
    return item


def broken(item):
    raise RuntimeError("no")


def test_every_item_gets_a_row(spark):
    rows = process_items(range_items(spark, 20), square, "long", tasks=4).orderBy("item").collect()
    assert [(r["item"], r["status"], r["result"]) for r in rows] == [(i, "ok", i * i) for i in range(20)]


def test_shared_values_reach_every_call(spark):
    table = {i: f"name {i}" for i in range(10)}
    rows = process_items(range_items(spark, 10), named, shared={"table": table}).collect()
    assert {r["item"]: r["result"] for r in rows} == table


def test_failures_become_rows(spark, tmp_path):
    process_items(range_items(spark, 10), flaky, "long").write.parquet(str(tmp_path / "o"))
    outcome = spark.read.parquet(str(tmp_path / "o"))
    assert check_outcome(outcome) == {"ok": 7, "failed": 3}
    found = {r["item"]: r["error"] for r in failures(outcome).collect()}
    assert found == {i: f"ValueError: cannot do {i}" for i in (2, 5, 8)}


def test_text_items(spark):
    items = range_items(spark, 3).select(F.concat(F.lit("f"), "item").alias("item"))
    rows = process_items(items, len, "long").collect()
    assert [r["result"] for r in rows] == [2, 2, 2]


def test_all_failed_is_an_error(spark):
    with pytest.raises(RuntimeError, match="all 5 items failed"):
        check_outcome(process_items(range_items(spark, 5), broken))


def test_retry_by_difference(spark, tmp_path):
    path = str(tmp_path / "out")
    assert process_missing(range_items(spark, 10), path, flaky, "long") == {"ok": 7, "failed": 3}
    assert process_missing(range_items(spark, 12), path, square, "long") == {"ok": 12}
    done = spark.read.parquet(path).filter("status = 'ok'")
    assert done.count() == 12 and done.select("item").distinct().count() == 12


def test_a_run_in_which_all_fail_is_an_error_after_a_good_one(spark, tmp_path):
    path = str(tmp_path / "again")
    process_missing(range_items(spark, 5), path, square, "long")
    with pytest.raises(RuntimeError, match="all 3 items failed"):
        process_missing(range_items(spark, 8), path, broken, "long")
    assert process_missing(range_items(spark, 5), path, broken, "long") == {"ok": 5, "failed": 3}


def test_a_run_that_dies_keeps_its_finished_batches(spark, tmp_path, monkeypatch):
    path, real, started = str(tmp_path / "out"), fanout.process_items, []

    def dies_in_the_third(part, *args, **kwargs):
        started.append(sorted(r["item"] for r in part.collect()))
        if len(started) == 3:
            raise SystemExit("the driver is lost")
        return real(part, *args, **kwargs)

    monkeypatch.setattr(fanout, "process_items", dies_in_the_third)
    with pytest.raises(SystemExit):
        process_missing(range_items(spark, 40), path, square, "long", batch_items=8)
    kept = {r["item"] for r in spark.read.parquet(path).collect()}
    assert kept == {*started[0], *started[1]} and 0 < len(kept) < 40

    def watch(part, *args, **kwargs):
        again.extend(r["item"] for r in part.collect())
        return real(part, *args, **kwargs)

    again = []
    monkeypatch.setattr(fanout, "process_items", watch)
    assert process_missing(range_items(spark, 40), path, square, "long", batch_items=8) == {"ok": 40}
    assert sorted(again) == sorted(set(range(40)) - kept)
    assert spark.read.parquet(path).count() == 40
