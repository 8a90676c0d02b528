import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from conftest import curve

from pointlake.operators.aggregates import shard_metrics
from pointlake.operators.condense import summarize
from pointlake.plans.shards_to_lake import shards_to_lake
from pointlake.sources.shards import _member_runs, list_shards, scan_shards

DIMS = 6
BIG = 123456789012345678


def _write(folder, shards, dims=DIMS):
    rng = np.random.default_rng(6)
    features = {}
    for shard, members in shards.items():
        with zipfile.ZipFile(folder / f"{shard}.zip", "w") as archive:
            for root, xyz in members.items():
                vectors = np.cumsum(rng.normal(size=(len(xyz), dims)), axis=0).astype("float32")
                features[(shard, root)] = vectors
                lines = [
                    ",".join([str(2**63 + i), *map(repr, map(float, np.float32(p))), *map(repr, map(float, v))])
                    for i, (p, v) in enumerate(zip(xyz, vectors, strict=True))
                ]
                archive.writestr(f"{root}.csv", "".join(line + "\n" for line in lines))
    return features


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    members = {
        0: {11: np.empty((0, 3)), 12: curve(1, 1), 13: curve(2, 2), 14: curve(3, 3), 15: curve(4, 4), BIG: curve(50, 5)},
        1: {BIG: np.vstack([curve(30, 6), curve(30, 7) + 1e5]), 16: np.ones((7, 3))},
    }
    return folder, members, _write(folder, members)


def test_scan_shards(spark, shards):
    folder, members, features = shards
    rows = scan_shards(spark, str(folder), DIMS).collect()
    assert len(rows) == sum(len(v) for m in members.values() for v in m.values())
    for r in rows:
        np.testing.assert_allclose([r["x"], r["y"], r["z"]], members[r["shard"]][r["root_id"]][r["pid"]], rtol=1e-6)
        assert r["embedding"] == features[(r["shard"], r["root_id"])][r["pid"]].tolist()
        assert int(r["node_id"]) == 2**63 + r["pid"]
    kept = scan_shards(spark, str(folder), DIMS, keep=2).first()["embedding"]
    assert len(kept) == 2


def _shown(df):
    return sorted(map(str, df.withColumn("node_id", df["node_id"].cast("string")).collect()))


def test_large_archives_are_read_by_several_tasks(spark, shards):
    """Above the bound each task reads some members of an archive, from its directory; the rows are the same."""
    folder, members, _ = shards
    whole = scan_shards(spark, str(folder), DIMS)
    for bound in (1, 2_000):
        assert _shown(scan_shards(spark, str(folder), DIMS, whole_bytes=bound)) == _shown(whole)
    path = f"file:{folder}/0.zip"
    directory = pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
    runs = [m for batch in _member_runs(500)([directory]) for m in batch.column(1).to_pylist()]
    assert len(runs) > 1 and [n for run in runs for n in run] == [f"{root}.csv" for root in members[0]]


def test_only_the_asked_part_of_an_archive_is_read(tmp_path):
    rng = np.random.default_rng(1)
    with zipfile.ZipFile(tmp_path / "0.zip", "w") as archive:
        for i in range(20):
            archive.writestr(f"{i}.csv", rng.bytes(1_000_000))
    reads = []

    class Counted(io.FileIO):
        def readinto(self, target):
            n = super().readinto(target)
            reads.append(n)
            return n

        def read(self, size=-1):
            data = super().read(size)
            reads.append(len(data))
            return data

    with zipfile.ZipFile(Counted(tmp_path / "0.zip")) as archive, archive.open("7.csv") as member:
        assert len(member.read()) == 1_000_000
    assert sum(reads) < 1_200_000


@pytest.mark.parametrize("line", ["1,x,2,3,4,5,6,7,8,9", "1,2,3,4,5", "1,2,3,4,5,6,7,8,9,10,11"])
def test_a_line_of_other_values_or_length_is_refused(spark, tmp_path, line):
    _write(tmp_path, {0: {1: curve(3, 0)}}, dims=DIMS)
    with zipfile.ZipFile(tmp_path / "0.zip", "a") as archive:
        archive.writestr("2.csv", line + "\n")
    with pytest.raises(Exception, match="CSV"):
        scan_shards(spark, str(tmp_path), DIMS).collect()


def test_an_empty_value_is_null(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "0.zip", "w") as archive:
        archive.writestr("2.csv", "1,1,2,3,1,,3,4,5,6\n\n2,1,2,3,1,2,3,4,5,6\n")
    rows = scan_shards(spark, str(tmp_path), DIMS, keep=3).orderBy("pid").collect()
    assert [r["embedding"] for r in rows] == [[1.0, None, 3.0], [1.0, 2.0, 3.0]]


def test_shard_metrics(spark, shards):
    folder, _, _ = shards
    found = shard_metrics(scan_shards(spark, str(folder), DIMS), list_shards(spark, str(folder))).orderBy("shard").collect()
    assert [(r["n_objects"], r["n_points"]) for r in found] == [(5, 60), (2, 67)]
    assert found[0]["shard_n_bytes"] == (folder / "0.zip").stat().st_size


def test_lake_tables(spark, shards, tmp_path):
    folder, members, features = shards
    paths = shards_to_lake(spark, str(folder), str(tmp_path), threshold=4.0, dims=DIMS, keep=4)
    raw = spark.read.parquet(paths.raw)
    assert raw.count() == 127 and len(raw.first()["embedding"]) == DIMS
    maps = spark.read.parquet(paths.maps).toPandas()
    condensed = spark.read.parquet(paths.condensed).toPandas().set_index(["shard", "root_id", "condensed_id"])
    assert len(maps) == 127
    for (shard, root), mine in maps.groupby(["shard", "root_id"]):
        xyz = np.float32(members[shard][root])
        assert sorted(mine["condensed_id"].unique()) == list(range(mine["condensed_id"].max() + 1))
        assert sorted(mine["pid"]) == list(range(len(xyz)))
        for cid, group in mine.groupby("condensed_id"):
            pids = np.sort(group["pid"].to_numpy())
            row = condensed.loc[(shard, root, cid)]
            vectors = features[(shard, root)][pids, :4].astype("float64")
            np.testing.assert_allclose(list(row["embedding"]), vectors.mean(axis=0), rtol=1e-5, atol=1e-6)
            far = np.linalg.norm(xyz[pids].astype("float64") - xyz[pids].astype("float64").mean(axis=0), axis=1)
            np.testing.assert_array_equal(np.float32([row["x"], row["y"], row["z"]]), xyz[pids[far.argmin()]])
    assert 7 < len(condensed) < 100
    # A rerun replaces the same partitions.
    shards_to_lake(spark, str(folder), str(tmp_path), threshold=4.0, dims=DIMS, keep=4)
    assert spark.read.parquet(paths.maps).count() == 127


def test_summary_of_given_labels_with_a_split_cluster(spark):
    xyz = curve(40, 3)
    rows = [(0, 5, i, *map(float, p), [float(i), 1.0], 0 if i < 30 else 30) for i, p in enumerate(xyz)]
    schema = "shard long, root_id long, pid long, x double, y double, z double, embedding array<float>, cluster long"
    condensed, mapping = summarize(spark.createDataFrame(rows, schema), 2, hot_rows=10)
    found = {r["condensed_id"]: r for r in condensed.collect()}
    assert found[0]["embedding"] == [14.5, 1.0] and found[1]["embedding"] == [34.5, 1.0]
    nearest = np.linalg.norm(xyz[:30] - xyz[:30].mean(axis=0), axis=1).argmin()
    assert found[0]["x"] == xyz[nearest][0]
    assert mapping.filter("condensed_id = 0").count() == 30
