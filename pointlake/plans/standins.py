"""The driver's tables in the shapes the jobs expect."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.workspace import Workspace

DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the label is the object, the first elements its coordinates."""
    return table(spark, sf_dir, "embeddings").select(
        F.pmod("label", F.lit(4)).cast("long").alias("shard"),
        F.col("label").cast("long").alias("root_id"),
        F.col("vec_id").alias("pid"),
        *[F.col("embedding")[i].alias(c) for i, c in enumerate("xyz")],
        "embedding",
    )


def write_dump(
    df: DataFrame, work: Workspace, name: str, fields: dict[str, str], compression: str = "none"
) -> tuple[str, str]:
    """Write ``df`` as a headerless CSV dump with its sidecar; returns both paths."""
    spark = df.sparkSession
    csv, sidecar = work.location(f"{name}-csv"), work.location(f"{name}-header")
    text: dict[str, Column] = {}
    for field, dtype in fields.items():
        if dtype == "boolean":
            text[field] = F.when(F.col(field), "t").when(~F.col(field), "f")
        elif dtype.startswith("timestamp"):
            text[field] = F.date_format(field, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    df.select(*fields).withColumns(text).write.option("escape", '"').option("emptyValue", '""').csv(csv, compression=compression)
    rows = spark.createDataFrame(list(fields.items()), "field string, dtype string")
    rows.coalesce(1).write.csv(sidecar)
    return csv, sidecar


def write_shards(pts: DataFrame, work: Workspace) -> str:
    """Write points as zipped shards of CSV members, streaming each archive from one task."""
    root = work.location("shards")

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri = root if "://" in root else f"file://{root}"
        target, base = pafs.FileSystem.from_uri(uri)
        target.create_dir(base, recursive=True)
        opened: dict[str, object] = {}

        def close() -> None:
            for part in ("member", "zip", "stream"):
                if part in opened:
                    opened.pop(part).close()

        shard = root_id = None
        for frame in frames:
            for (s, r), rows in frame.groupby(["shard", "root_id"], sort=False):
                if s != shard:
                    close()
                    opened["stream"] = target.open_output_stream(f"{base}/{s}.zip")
                    opened["zip"] = zipfile.ZipFile(opened["stream"], "w", zipfile.ZIP_DEFLATED)
                if (s, r) != (shard, root_id):
                    if "member" in opened:
                        opened.pop("member").close()
                    opened["member"] = opened["zip"].open(f"{r}.csv", "w")
                    shard, root_id = s, r
                opened["member"].write(("\n".join(rows["line"]) + "\n").encode())
        close()
        yield from ()

    cells = [F.col("pid").cast("string"), *[F.col(c).cast("string") for c in "xyz"]]
    line = F.concat_ws(",", *cells, F.array_join(F.col("embedding").cast("array<string>"), ","))
    lines = pts.select("shard", "root_id", "pid", line.alias("line")).repartition("shard")
    ordered = lines.sortWithinPartitions("shard", "root_id", "pid").drop("pid")
    ordered.mapInPandas(archive, "done int").count()
    return root
