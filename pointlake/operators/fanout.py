"""Apply a function to every work item, keeping failures as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.operators.joins import remaining_items
from pointlake.workspace import Workspace


def process_items(
    items: DataFrame,
    function: Callable,
    result_type: str = "string",
    item: str = "item",
    shared: Mapping[str, object] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """``(item, status, result, error)``, one row per item.

    ``function(item, **shared)`` runs once per row inside Spark tasks. An exception
    gives a ``failed`` row with its message and the other items go on; losing an
    executor reruns only its tasks. ``shared`` values are broadcast once. A function
    that writes its own output returns a short status or ``None``. Give items of
    uneven cost more ``tasks``.
    """
    broadcasts = {k: items.sparkSession.sparkContext.broadcast(v) for k, v in (shared or {}).items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arguments = {name: value.value for name, value in broadcasts.items()}
        for frame in frames:
            rows = []
            for value in frame[item]:
                try:
                    rows.append((value, "ok", function(value, **arguments), None))
                except Exception as failure:  # noqa: BLE001 - any failure becomes a row
                    rows.append((value, "failed", None, f"{type(failure).__name__}: {failure}"))
            if rows:
                yield pd.DataFrame(rows, columns=[item, "status", "result", "error"]).astype({item: frame[item].dtype})

    spread = items.select(item)
    if tasks:
        spread = spread.repartition(tasks)
    kind = items.schema[item].dataType.simpleString()
    return spread.mapInPandas(run, f"`{item}` {kind}, status string, result {result_type}, error string")


def failures(outcome: DataFrame, item: str = "item") -> DataFrame:
    return outcome.filter("status = 'failed'").select(item, "error")


def status_counts(outcome: DataFrame) -> dict[str, int]:
    return {row["status"]: row["count"] for row in outcome.groupBy("status").count().collect()}


def _refuse_all_failed(counts: Mapping[str, int]) -> None:
    if counts.get("failed") and not counts.get("ok"):
        raise RuntimeError(f"all {counts['failed']} items failed")


def check_outcome(outcome: DataFrame) -> dict[str, int]:
    """Counts per status of a *stored* outcome; an error when every item failed."""
    counts = status_counts(outcome)
    _refuse_all_failed(counts)
    return counts


# Items whose outcome is stored together: what a driver that dies can lose.
BATCH_ITEMS = 100_000


def process_missing(
    items: DataFrame,
    output_path: str,
    function: Callable,
    result_type: str = "string",
    item: str = "item",
    shared: Mapping[str, object] | None = None,
    tasks: int | None = None,
    batch_items: int = BATCH_ITEMS,
) -> dict[str, int]:
    """Process the items without an ``ok`` row in ``output_path`` and append the outcome.

    Items are dealt by a hash into batches of about ``batch_items``, and the outcome of
    each batch is appended when it is done: a run that ends half-way keeps its finished
    batches. Running it again retries exactly the failed and the never-started items; an
    item with two rows counts once. It is an error if every item of this run failed,
    whatever earlier runs did. Returns the items' counts per latest status over all runs.
    """
    spark = items.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output_path)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if exists:
        done = spark.read.parquet(output_path).filter("status = 'ok'")
        items = remaining_items(items, done, [item])
    work = Workspace(spark)
    todo = work.save(items.select(item), "items")
    batches = max(1, -(-todo.count() // batch_items))
    counts: Counter[str] = Counter()
    try:
        for batch in range(batches):
            part = todo.filter(F.pmod(F.xxhash64(item), F.lit(batches)) == batch)
            # Stored first: what this batch did is counted and appended from one execution.
            outcome = work.save(process_items(part, function, result_type, item, shared, tasks), "outcome")
            outcome.write.mode("append").parquet(output_path)
            counts.update(status_counts(outcome))
        _refuse_all_failed(counts)
    finally:
        work.delete()
    latest = spark.read.parquet(output_path)
    done_now = F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("done")
    per_item = latest.groupBy(item).agg(done_now)
    return status_counts(per_item.select(F.when(F.col("done") == 1, "ok").otherwise("failed").alias("status")))
