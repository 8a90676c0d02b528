import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointlake.functions.columns import with_id_partitions
from pointlake.sinks import zorder
from pointlake.sinks.partitioned import bloom_options, write_partitioned
from pointlake.sinks.sizes import storage_by_layout, stored_bytes, unpivot_sizes, with_projection
from pointlake.sinks.zorder import zorder_merge, zorder_rewrite, zorder_table
from pointlake.sources.items import file_items, normal_arrays, range_items
from pointlake.sources.lake import lookup, scan_lake


def _ids(spark, n=2000):
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("root"))
    return with_id_partitions(rows, ["root"], 8)


def test_lookup_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "lake")
    write_partitioned(_ids(spark), path, ["root_partition"], sort_by=["root"])
    found = lookup(scan_lake(spark, path), "root", [5, 13, 700], 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "root_partition" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "root" in scan.split("PushedFilters")[1]
    expected = sorted(i for i in range(2000) if i * 7919 % 1009 in (5, 13, 700))
    assert sorted(r["id"] for r in found.collect()) == expected


def test_bloom_filter_only_where_asked(spark, tmp_path):
    path = str(tmp_path / "bloom")
    # Wide enough a range that the writer gives up dictionary encoding.
    rows = spark.range(200_000).select(F.col("id"), (F.col("id") * 3).alias("other"))
    write_partitioned(rows, path, [], bloom=bloom_options(["id"], 0.001, 200_000))
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(glob.glob(f"{path}/part-*")[0])
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in columns}
    reader.close()
    assert offsets["id"] > 0 and offsets["other"] == -1


def test_writing_the_same_partitions_twice_replaces_them(spark, tmp_path):
    path = str(tmp_path / "twice")
    rows = _ids(spark)
    write_partitioned(rows, path, ["root_partition"])
    write_partitioned(rows.filter("root_partition < 3"), path, ["root_partition"], replace="partitions")
    assert spark.read.parquet(path).count() == 2000
    write_partitioned(rows.filter("root_partition = 3"), path, ["root_partition"], mode="append")
    assert spark.read.parquet(path).count() == 2000 + rows.filter("root_partition = 3").count()


def test_rows_per_file(spark, tmp_path):
    path = str(tmp_path / "files")
    write_partitioned(_ids(spark), path, [], rows_per_file=300, codec="zstd")
    files = glob.glob(f"{path}/part-*")
    assert all(pq.read_metadata(f).num_rows <= 300 for f in files)
    assert pq.read_metadata(files[0]).row_group(0).column(0).compression == "ZSTD"


def test_zorder_keeps_rows_and_narrows_files(spark, tmp_path):
    source, target = str(tmp_path / "src"), str(tmp_path / "dst")
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 1009).alias("a"),
        (F.col("id") * 104729 % 2003).alias("b"),
        "id",
    )
    rows.write.parquet(source)
    zorder_rewrite(spark, source, target, ["a", "b"], files=16)
    back = spark.read.parquet(target)
    assert back.columns == ["a", "b", "id"]
    assert rows.exceptAll(back).count() == 0 and back.count() == 40_000

    def touched(column, value):
        hits = 0
        for f in glob.glob(f"{target}/part-*"):
            meta = pq.read_metadata(f)
            place = meta.schema.names.index(column)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(place).statistics
                hits += stats.has_min_max and stats.min <= value <= stats.max
        return hits

    counts = [touched("a", v) for v in (100, 500, 900)] + [touched("b", v) for v in (200, 1000, 1800)]
    assert sum(counts) / len(counts) <= 8, counts


@pytest.mark.parametrize("partition_by", [[], ["part"]])
def test_zorder_merge_writes_only_what_receives_rows(spark, tmp_path, partition_by):
    target = str(tmp_path / "grown")
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 1009).alias("a"),
        (F.col("id") * 104729 % 2003).cast("int").alias("b"), "id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("part"),
    )
    zorder_table(rows, target, ["a", "b"], partition_by, ranges=16)
    files = lambda: {os.path.relpath(f, target) for f in glob.glob(f"{target}/**/part-*", recursive=True)}
    before = files()
    assert len({f.rsplit("/", 1)[0] for f in before}) >= 16
    new = spark.range(20_000, 20_300).select((F.col("id") % 20).alias("a"), (F.col("id") % 30).cast("int").alias("b"), "id", F.lit(1).cast("long").alias("part"))
    assert 0 < len(zorder_merge(spark, new, target)) <= 4
    kept = before & files()
    assert len(kept) >= len(before) * 0.6 and files() - before
    back = spark.read.parquet(target).drop("z_range").select(rows.columns)
    assert back.withColumn("part", F.col("part").cast("long")).exceptAll(rows.union(new)).count() == 0 and back.count() == 20_300
    odd = spark.createDataFrame([(None, 10**6, 1, None), (-5, -5, 2, None)], "a long, b int, id long, part long")
    zorder_merge(spark, odd, target)
    assert spark.read.parquet(target).count() == 20_302
    assert zorder_merge(spark, odd.limit(0), target) == []


def test_zorder_splits_one_repeated_value(spark, tmp_path):
    source, target = str(tmp_path / "hot"), str(tmp_path / "hot-out")
    spark.range(20_000).select(F.lit(7).alias("a"), "id").write.parquet(source)
    zorder_rewrite(spark, source, target, ["a"], files=4)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{target}/part-*")]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


@pytest.mark.parametrize("bound, rows_per_file", [("_SORTED_ROWS", 50_000_000), ("_SMALLEST_FILE", 500)])
def test_zorder_ranges_are_bounded_in_rows(spark, tmp_path, monkeypatch, bound, rows_per_file):
    """Narrow rows are stored in few bytes; neither a task's sort nor the files it writes one by one grow with them."""
    source, target = str(tmp_path / "narrow"), str(tmp_path / "narrow-out")
    rows = spark.range(20_000).select((F.col("id") * 7919 % 1009).alias("a"), "id")
    rows.write.parquet(source)
    monkeypatch.setattr(zorder, bound, 500)
    zorder_rewrite(spark, source, target, ["a"], rows_per_file=rows_per_file)
    tasks = {os.path.basename(f).split("-")[1] for f in glob.glob(f"{target}/part-*")}
    assert len(tasks) >= 35
    back = spark.read.parquet(target)
    assert rows.exceptAll(back).count() == 0 and back.count() == 20_000


def test_unsigned_ids_become_longs(spark, tmp_path):
    spark.sql("select cast(5 as decimal(20,0)) as id").write.parquet(str(tmp_path / "u"))
    assert scan_lake(spark, str(tmp_path / "u")).dtypes == [("id", "bigint")]


def test_sizes(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, size in ((a, 10), (b, 2048)):
        folder.mkdir()
        (folder / "data.bin").write_bytes(b"x" * size)
    sizes = storage_by_layout(spark, {"a": str(a), "b": str(b)})
    assert {r["format"]: r["size_bytes"] for r in sizes.collect()} == {"a": 10, "b": 2048}
    assert stored_bytes(spark, str(b)) == 2048
    wide = spark.createDataFrame([(8, 16)], "raw long, condensed long")
    found = {r["format"]: r["projected_size_gigabytes"] for r in with_projection(unpivot_sizes(wide), 50_000, 8).collect()}
    assert found["raw"] == pytest.approx(8 * 6250 / 1024**3)
    assert [r["item"].endswith("data.bin") for r in file_items(spark, str(a)).collect()] == [True]


def test_generated_items(spark):
    assert [r["item"] for r in range_items(spark, 10, 3).orderBy("item").collect()] == list(range(10))
    counts = normal_arrays(spark, 5, 100).groupBy("array_id").count().collect()
    assert sorted((r["array_id"], r["count"]) for r in counts) == [(i, 100) for i in range(5)]


@pytest.mark.parametrize("ordered", [False, True])
def test_a_smaller_table_leaves_nothing_of_the_larger(spark, tmp_path, ordered):
    path, staged = str(tmp_path / "smaller"), str(tmp_path / "staged")
    for n in (2000, 30):
        if ordered:
            _ids(spark, n).write.mode("overwrite").parquet(staged)
            zorder_rewrite(spark, staged, path, ["id"], ["root_partition"])
        else:
            write_partitioned(_ids(spark, n), path, ["root_partition"])
    assert spark.read.parquet(path).count() == 30


def test_unknown_extent_of_an_overwrite(spark, tmp_path):
    with pytest.raises(ValueError, match="extent"):
        write_partitioned(_ids(spark, 10), str(tmp_path / "x"), ["root_partition"], replace="rows")


def test_text_and_dates_are_clustered(spark, tmp_path):
    rows = spark.range(8000).select(
        "id",
        F.expr("date_add(date'2020-01-01', cast(id * 7919 % 1000 as int))").alias("day"),
        F.when(F.col("id") % 50 != 0, F.sha1(F.col("id").cast("string"))).alias("name"),
        F.expr("timestamp_seconds(id * 104729 % 100000)").alias("at"),
    )
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    rows.write.parquet(source)
    zorder_rewrite(spark, source, target, ["day", "name", "at"], files=16, rows_per_file=400, codec="gzip")
    back = spark.read.parquet(target)
    assert sorted(back.collect()) == sorted(rows.collect())
    files = [pq.ParquetFile(f) for f in glob.glob(f"{target}/*.parquet")]
    assert all(f.metadata.num_rows <= 400 for f in files)
    assert files[0].metadata.row_group(0).column(0).compression == "GZIP"
    spans = [f.metadata.row_group(0).column(1).statistics for f in files if f.metadata.num_rows > 100]
    days = [(s.max - s.min).days for s in spans]
    assert sum(days) / len(days) < 750


def test_text_counts_by_its_first_six_bytes(spark):
    texts = [b"", b"a", b"R", b"abcdef", b"abcdefgh", "\u00fc\u4e2d\U0001f600".encode(), bytes([0, 255, 128, 1, 0, 7]), None]
    rows = spark.createDataFrame([(None if t is None else bytearray(t),) for t in texts], "t binary")
    found = rows.select("t", zorder._as_double(rows, "t").alias("n")).collect()
    assert all(r["n"] == (None if r["t"] is None else int.from_bytes(bytes(r["t"])[:6].ljust(6, b"\0"))) for r in found)
    words = spark.createDataFrame([("",), ("\u00e9t\u00e9",), (None,)], "t string")
    assert [r["n"] for r in words.select(zorder._as_double(words, "t").alias("n")).collect()] == [0.0, float(0xC3A974C3A900), None]


def test_bloom_rate_is_met_in_large_row_groups(spark, tmp_path):
    path, n = str(tmp_path / "rate"), 1_500_000
    ids = spark.range(n).select(F.xxhash64("id").alias("id")).coalesce(1)
    write_partitioned(ids, path, [], bloom=bloom_options(["id"], fpp=0.001), clustered=True)
    jvm = spark.sparkContext._jvm
    (file,) = glob.glob(f"{path}/*.parquet")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    block = reader.getFooter().getBlocks().get(0)
    assert block.getRowCount() > 1_000_000
    filters = reader.getBloomFilterDataReader(block).readBloomFilter(block.getColumns().get(0))
    boxed = jvm.java.lang.Long.valueOf
    absent = [r["id"] for r in spark.range(n, n + 3000).select(F.xxhash64("id").alias("id")).collect()]
    wrong = sum(filters.findHash(filters.hash(boxed(i))) for i in absent)
    reader.close()
    assert wrong <= 20
